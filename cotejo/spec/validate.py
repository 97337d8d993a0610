"""Findings of a record file: structure, fields, occurrences, positions and rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.spec.layout import Layout, Rule
from cotejo.spec.readers import Parsed
from cotejo.spec.rules import broken_rules, check_rule

FINDING = ("severity", "origin", "message", "line", "record_type", "field", "rule")


def _finding(df: DataFrame, origin: str, message, line="line", record=None, field=None, rule=None) -> DataFrame:
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    at = F.col(line).cast("long") if line else F.lit(None).cast("long")
    return df.select(F.lit("error").alias("severity"), F.lit(origin).alias("origin"), text(message).alias("message"), at.alias("line"), text(record).alias("record_type"), text(field).alias("field"), text(rule).alias("rule"))


def occurrences(parsed: Parsed, layout: Layout, spark: SparkSession) -> DataFrame:
    """Record types that occur too rarely or too often, and first and last records that stand elsewhere."""
    limits = spark.createDataFrame([(r.code, r.least, r.most) for r in layout.records], "code string, least int, most int")
    counted = parsed.order.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    joined = F.broadcast(limits).join(counted, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    n = F.col("n").cast("string")
    few = F.concat(F.lit("record "), "code", F.lit(" occurs "), n, F.lit(" times; at least "), F.col("least").cast("string"), F.lit(" are needed"))
    many = F.concat(F.lit("record "), "code", F.lit(" occurs "), n, F.lit(" times; at most "), F.col("most").cast("string"), F.lit(" are allowed"))
    told = joined.withColumn("m", F.when(F.col("n") < F.col("least"), few).when(F.col("n") > F.col("most"), many)).filter("m IS NOT NULL")
    out = _finding(told, "occurrences", F.col("m"), None, F.col("code"))
    ends = parsed.order.agg(F.min_by("code", "line").alias("first"), F.max_by("code", "line").alias("last"), F.min("line").alias("a"), F.max("line").alias("z"))
    for r in layout.records:
        if layout.format != "xml" and r.place in ("first", "last"):
            line = "a" if r.place == "first" else "z"
            out = out.unionByName(_finding(ends.filter(F.col(r.place) != r.code), "occurrences", f"the {r.place} record should be {r.code}", line, r.code))
    return out


def validate(parsed: Parsed, layout: Layout, spark: SparkSession) -> DataFrame:
    """All findings as one DataFrame of FINDING columns. A rule that cannot be compiled is a finding itself."""
    frames = [_finding(parsed.structure, "structure", F.col("message"))]
    for r in layout.records:
        wrong = parsed.frames[r.code].filter(F.size("_errors") > 0).select("_line", F.explode("_errors").alias("e"))
        frames.append(_finding(wrong, "field", F.col("e.message"), "_line", r.code, F.col("e.field")))
    frames.append(occurrences(parsed, layout, spark))
    sound: dict[str | None, list[Rule]] = {}
    for rule in layout.rules:
        faults = check_rule(rule, layout)
        if faults:
            frames.append(_finding(spark.range(1), "rule", faults[0], None, rule.record, None, rule.id))
        else:
            sound.setdefault(rule.record if rule.scope == "record" else None, []).append(rule)
    for record, rules in sound.items():
        broken = broken_rules(rules, layout, record, parsed.frames, spark)
        said = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.id, r.description or r.expression)]), F.col("rule"))
        frames.append(_finding(broken, "rule", said, "_line" if record else None, record, None, F.col("rule")))
    return reduce(lambda a, b: a.unionByName(b), frames)
