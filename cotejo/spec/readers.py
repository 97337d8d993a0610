"""Record files as one DataFrame per record type."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.sources.lines import numbered, read_lines
from cotejo.spec.layout import Layout, Record
from cotejo.spec.values import parse

ERRORS = "array<struct<field:string,message:string>>"


@dataclass
class Parsed:
    """structure: (line, message) of lines that are no record. frames: by code, _line, the typed fields, _errors. order: (line,
    code) of every record."""

    structure: DataFrame
    frames: dict[str, DataFrame]
    order: DataFrame


def _records(lines: DataFrame, layout: Layout, code: Column, raw, fault: Column) -> Parsed:
    marked = lines.withColumn("_fault", fault).withColumn("_code", F.when(F.col("_fault").isNull(), code))
    structure = marked.filter(F.col("_fault").isNotNull()).select("line", F.col("_fault").alias("message"))
    frames = {}
    for r in layout.records:
        own = marked.filter(F.col("_code") == r.code)
        values, errors = [], []
        for f in r.fields:
            value, error = parse(f, raw(r, f), layout.mode)
            values.append(value.alias(f.name))
            errors.append(F.when(error.isNotNull(), F.struct(F.lit(f.name).alias("field"), error.alias("message"))))
        found = F.filter(F.array(*errors), lambda x: x.isNotNull()) if errors else F.array()
        frames[r.code] = own.select(F.col("line").alias("_line"), *values, found.cast(ERRORS).alias("_errors"))
    return Parsed(structure, frames, marked.filter(F.col("_code").isNotNull()).select("line", F.col("_code").alias("code")))


def parse_fixed(lines: DataFrame, layout: Layout) -> Parsed:
    """lines: (line, value). A record is told by the first type whose constant stands in its place."""
    code = F.lit(None).cast("string")
    for r in reversed(layout.records):
        c = r.identifier
        if c is not None and c.start:
            code = F.when(F.trim(F.substring("value", c.start, c.length)) == c.constant.strip(), F.lit(r.code)).otherwise(code)
    size = F.length("value")
    wrong = F.concat(F.lit("the line has "), size.cast("string"), F.lit(f" characters, not {layout.line_length}"))
    fault = F.when(size != layout.line_length, wrong) if layout.line_length else F.lit(None).cast("string")
    fault = F.coalesce(fault, F.when(code.isNull(), F.lit("the record type is not known")))
    return _records(lines, layout, code, lambda r, f: F.substring("value", f.start, f.length), fault)


def parse_delimited(lines: DataFrame, layout: Layout) -> Parsed:
    """Fields are split at the separator, without quoting."""
    split = lines.withColumn("_parts", F.split("value", re.escape(layout.separator or ";"), -1))
    if len(layout.records) == 1:
        code = F.lit(layout.records[0].code)
    else:
        code = F.lit(None).cast("string")
        for r in reversed(layout.records):
            if r.identifier is not None:
                at = F.get("_parts", F.lit(r.fields.index(r.identifier)))
                code = F.when(F.trim(at) == r.identifier.constant.strip(), F.lit(r.code)).otherwise(code)
    wanted = F.lit(None).cast("int")
    for r in layout.records:
        wanted = F.when(code == r.code, F.lit(len(r.fields))).otherwise(wanted)
    size = F.size("_parts")
    wrong = F.concat(F.lit("the line has "), size.cast("string"), F.lit(" fields; record "), code, F.lit(" has "), wanted.cast("string"))
    fault = F.when(code.isNull(), F.lit("the record type is not known")).when(size != wanted, wrong)
    return _records(split, layout, code, lambda r, f: F.get("_parts", F.lit(r.fields.index(f))), fault)


def parse_xml(spark: SparkSession, path: str, layout: Layout) -> Parsed:
    """Flat XML: the root's children are records, their children fields. Each record type is read by Spark's XML source, so
    files are split between tasks; unknown root children are found by reading the root once."""
    frames, orders = {}, []
    for r in layout.records:
        tag = r.xml_tag or r.code
        schema = ", ".join(f"`{f.xml_tag or f.name}` string" for f in r.fields)
        df = numbered(spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", False).schema(schema).load(path), "line")
        values, errors = [], []
        for f in r.fields:
            value, error = parse(f, F.col(f"`{f.xml_tag or f.name}`"), "xml")
            values.append(value.alias(f.name))
            errors.append(F.when(error.isNotNull(), F.struct(F.lit(f.name).alias("field"), error.alias("message"))))
        frames[r.code] = df.select(F.col("line").alias("_line"), *values, F.filter(F.array(*errors), lambda x: x.isNotNull()).cast(ERRORS).alias("_errors"))
        orders.append(df.select("line", F.lit(r.code).alias("code")))
    known = [r.xml_tag or r.code for r in layout.records]
    tags = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"<([A-Za-z_][\w.-]*)"), F.lit(1))).alias("tag")).distinct()
    fields = [f.xml_tag or f.name for r in layout.records for f in r.fields]
    odd = tags.filter(~F.col("tag").isin(*known, *fields, layout.root_tag or ""))
    structure = odd.select(F.lit(None).cast("long").alias("line"), F.concat(F.lit("unknown element "), F.col("tag")).alias("message"))
    order = orders[0]
    for o in orders[1:]:
        order = order.unionByName(o)
    return Parsed(structure, frames, order)


def read_records(spark: SparkSession, path: str, layout: Layout) -> Parsed:
    if layout.format == "xml":
        return parse_xml(spark, path, layout)
    encoding = {"latin-1": "ISO-8859-1"}.get(layout.encoding, layout.encoding)
    lines = read_lines(spark, path, encoding)
    return parse_fixed(lines, layout) if layout.format == "fixed" else parse_delimited(lines, layout)


def repeatable(layout: Layout) -> Record:
    """The record type that a file's table view shows: the first that may repeat."""
    return next((r for r in layout.records if r.most is None or r.most > 1), layout.records[0])


def table_of(parsed: Parsed, record: Record) -> DataFrame:
    """A record type as a table of text, `_pos` from its line: decimals without trailing zeros, ISO dates."""
    df = parsed.frames[record.code]
    cells = []
    for f in record.fields:
        text = F.col(f.name).cast("string")
        cells.append((F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1").alias(f.name) if f.kind == "decimal" and f.decimals else text.alias(f.name)))
    cells = [F.regexp_replace(c, r"\.$", "").alias(f.name) if f.kind == "decimal" else c for c, f in zip(cells, record.fields)]
    return df.select(*cells, F.col("_line").alias("_pos"))


def detect_layout(spark: SparkSession, path: str, layouts: list[Layout], lines: int = 500) -> tuple[Layout, float] | None:
    """(best layout, its share of clean records) on the first lines; the first of equals. XML layouts are tried whole."""
    best = None
    for layout in layouts:
        if layout.format == "xml":
            if not path.lower().endswith(".xml"):
                continue
            parsed = read_records(spark, path, layout)
        else:
            encoding = {"latin-1": "ISO-8859-1"}.get(layout.encoding, layout.encoding)
            head = spark.read.option("lineSep", "\n").option("encoding", encoding).text(path).limit(lines)
            head = numbered(head.select(F.regexp_replace("value", "\r$", "").alias("value")))
            parsed = parse_fixed(head, layout) if layout.format == "fixed" else parse_delimited(head, layout)
        clean = total = 0
        for df in parsed.frames.values():
            row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("_errors") == 0).alias("c")).first()
            clean, total = clean + row.c, total + row.n
        total += parsed.structure.count()
        share = clean / total if total else 0.0
        if share > 0 and (best is None or share > best[1]):
            best = (layout, share)
    return best
