"""Inputs derived from the test tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def position(*columns: str) -> Column:
    """A row order that any engine can form: a struct of columns."""
    return F.struct(*columns).alias("_pos")


AMOUNT_TEXT = "cast(cast(o_totalprice AS decimal(18,2)) AS string)"
_BANK_KEY = "concat(substring(lpad(cast(o_orderkey AS string), 12, '0'), 1, 4), '-', substring(lpad(cast(o_orderkey AS string), 12, '0'), 5, 8))"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, amount, _pos of orders whose class is below 18."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 20 < 18")
    return o.select(F.col("o_orderkey").cast("string").alias("key"), F.expr(AMOUNT_TEXT).alias("amount"), position("o_orderkey"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref (disguised key), amount, status, _pos: cents off, halves, two instalments, voids and orders of its own."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("cast(o_totalprice AS decimal(18,2))").alias("a"), F.expr("o_orderkey % 20").alias("r")).filter("r <> 16")
    half = "cast(round(a * 0.5, 2) AS decimal(18,2))"
    parts = F.expr(
        f"CASE WHEN r = 11 THEN array(a + 0.01) WHEN r = 12 THEN array(a - 0.01) WHEN r IN (13, 14) THEN array({half})"
        f" WHEN r = 15 THEN array({half}, a - {half}) ELSE array(a) END"
    )
    rows = o.select("o_orderkey", "r", F.posexplode(parts).alias("part", "amount"))
    return rows.select(
        F.expr(_BANK_KEY).alias("ref"),
        F.col("amount").cast("decimal(18,2)").cast("string").alias("amount"),
        F.expr("if(r = 17, 'VOID', 'OK')").alias("status"),
        position("o_orderkey", "part"),
    )


SIDES_SQL = """
o AS (SELECT o_orderkey AS k, o_orderkey % 20 AS r, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders),
ledger AS (SELECT k, a AS amount FROM o WHERE r < 18),
bank AS (
  SELECT k, 0 AS part, CASE WHEN r = 11 THEN a + 0.01 WHEN r = 12 THEN a - 0.01 WHEN r IN (13, 14, 15) THEN CAST(round(a * 0.5, 2) AS DECIMAL(18,2)) ELSE a END AS amount,
         CASE WHEN r = 17 THEN 'VOID' ELSE 'OK' END AS status FROM o WHERE r <> 16
  UNION ALL SELECT k, 1, a - CAST(round(a * 0.5, 2) AS DECIMAL(18,2)), 'OK' FROM o WHERE r = 15)
"""

#: Orders by locale: text of the price as several countries print it.
LOCALES = {
    "es": "translate(format_number(p, 2), ',.', '.,')",
    "en": "format_number(p, 2)",
    "br": "concat('R$ ', translate(format_number(p, 2), ',.', '.,'))",
    "padded": "lpad(format_string('%.2f', p), 18, '0')",
    "comma": "translate(format_string('%.2f', p), '.', ',')",
    "word": "concat('n/a ', format_string('%.2f', p), 'd')",
}

#: A number of "%.6f" without trailing zeros.
def short_number(x: str) -> str:
    return f"regexp_replace(printf('%.6f', CAST({x} AS DOUBLE)), '\\.?0+$', '')"
