"""Files with one injected fault each, to measure how well a layout tells good files from bad ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.spec.layout import Field, Layout
from cotejo.spec.readers import parse_delimited, parse_fixed
from cotejo.spec.validate import validate


@dataclass(frozen=True)
class Mutation:
    name: str
    lines: DataFrame


def _bad_text(f: Field) -> str | None:
    """A text of the field's width that its kind or domain does not admit."""
    width = f.length or 1
    if f.kind == "constant":
        return "?" * width
    if f.kind == "date":
        return "9" * width
    if f.kind in ("integer", "decimal"):
        return "X".rjust(width, "0")
    if f.allowed or f.pattern:
        return "~" * width
    return " " * width if f.required else None


def mutations(lines: DataFrame, layout: Layout) -> list[Mutation]:
    """lines: (line, code, value) of a valid fixed-width file. One mutation per field and per structural fault, each at the first
    record of its type."""
    out = []
    firsts = {r.code: r.line for r in lines.groupBy("code").agg(F.min("line").alias("line")).collect()}
    for r in layout.records:
        if r.code not in firsts:
            continue
        here = F.col("line") == firsts[r.code]
        for f in r.fields:
            bad = _bad_text(f)
            if bad is None or not f.start:
                continue
            value = F.when(here, F.concat(F.substring("value", 1, f.start - 1), F.lit(bad), F.expr(f"substring(value, {f.start + f.length})"))).otherwise(F.col("value"))
            out.append(Mutation(f"{r.code}.{f.name}", lines.withColumn("value", value)))
        if r.least:
            out.append(Mutation(f"without {r.code}", lines.filter(F.col("code") != r.code)))
        if r.most == 1:
            twice = lines.unionByName(lines.filter(here))
            out.append(Mutation(f"two {r.code}", twice))
    last = lines.agg(F.max("line")).first()[0]
    out.append(Mutation("short line", lines.withColumn("value", F.when(F.col("line") == last, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value")))))
    return out


def detection(lines: DataFrame, layout: Layout, spark: SparkSession) -> DataFrame:
    """(mutation, found): how many findings each faulty file has; the unchanged file is "none" and should have 0."""
    parse = parse_fixed if layout.format == "fixed" else parse_delimited
    rows = []
    for m in [Mutation("none", lines), *mutations(lines, layout)]:
        rows.append((m.name, validate(parse(m.lines.select("line", "value"), layout), layout, spark).count()))
    return spark.createDataFrame(rows, "mutation string, found long")
