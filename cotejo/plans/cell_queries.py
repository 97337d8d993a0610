"""Filters, key forms, numbers, computed columns, totals and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions.text import composite_key, format_number, key_form, parse_number
from cotejo.operators.filters import Filter, split_by_filters, with_reason
from cotejo.operators.totals import Term, Threshold, Totals, apply_totals
from cotejo.plans.fixtures import LOCALES, position, short_number, table


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        F.expr("CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 11 = 1 THEN '  ' ELSE p_brand END").alias("brand"),
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN cast(p_size AS string) WHEN p_partkey % 3 = 1 THEN concat(p_size, '.00') ELSE concat(' ', p_size, ',0') END").alias("size"),
        F.col("p_type").alias("type"),
    )


_PARTS = """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 11 = 1 THEN '  ' ELSE p_brand END AS brand, p_size AS size, p_type AS type FROM part)
"""


def _kept(filter_: Filter):
    return lambda spark, sf_dir: split_by_filters(_parts(spark, sf_dir), [filter_])[0].select("p_partkey")


def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = [Filter("brand", "blank"), Filter("size", ">=", ("40",)), Filter("type", "contains", ("a", "e"), "keep"), Filter("brand", "=="), Filter("nowhere", "blank")]
    return with_reason(_parts(spark, sf_dir), chain).select("p_partkey", "reason")


CHAIN_SQL = _PARTS + """
SELECT p_partkey, CASE WHEN brand IS NULL OR trim(brand) = '' THEN 'drop brand is blank' WHEN size >= 40 THEN 'drop size at least 40'
  WHEN NOT (type ILIKE '%a%' OR type ILIKE '%e%') THEN 'keep only type contains a | e' END AS reason FROM p
"""


def key_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.expr("CASE c_custkey % 6 WHEN 0 THEN concat('  00', c_custkey, '-', c_nationkey, ' ') WHEN 1 THEN concat('ÁÉ ñ ', c_name, ' ü') WHEN 2 THEN 'NaN' WHEN 3 THEN '000' WHEN 4 THEN NULL ELSE concat('ab', c_custkey) END").alias("raw"),
    )
    return c.select("c_custkey", key_form("raw", "exact").alias("exact"), key_form("raw", "digits").alias("digits"), key_form("raw", "no_zeros").alias("no_zeros"), key_form("raw", "folded").alias("folded"), composite_key(["raw", "none"], "no_zeros", ["raw"]).alias("composite"))


KEY_FORMS_SQL = """
WITH r AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '  00' || c_custkey || '-' || c_nationkey || ' ' WHEN 1 THEN 'ÁÉ ñ ' || c_name || ' ü' WHEN 2 THEN 'NaN' WHEN 3 THEN '000' WHEN 4 THEN NULL ELSE 'ab' || c_custkey END AS raw FROM customer),
t AS (SELECT c_custkey, CASE WHEN lower(trim(raw)) IN ('nan', 'none', '<na>') THEN '' ELSE coalesce(trim(raw), '') END AS e FROM r),
d AS (SELECT *, regexp_replace(e, '[^0-9]', '', 'g') AS d FROM t)
SELECT c_custkey, e AS exact, CASE WHEN d <> '' AND ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END AS digits, CASE WHEN e <> '' AND ltrim(e, '0') = '' THEN '0' ELSE ltrim(e, '0') END AS no_zeros,
       regexp_replace(upper(strip_accents(e)), '\\s+', '', 'g') AS folded, CASE WHEN e <> '' AND ltrim(e, '0') = '' THEN '0' ELSE ltrim(e, '0') END || '|' AS composite FROM d
"""


def parse_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("round(o_totalprice, 2)").alias("p"))
    shown = o.select("o_orderkey", *[F.expr(e).alias(n) for n, e in LOCALES.items()])
    return shown.select("o_orderkey", *[parse_number(n).alias(n) for n in LOCALES], format_number(parse_number("es")).alias("text"))


PARSE_SQL = f"SELECT o_orderkey, round(o_totalprice, 2) AS es, es AS en, es AS br, es AS padded, es AS comma, CAST(NULL AS DOUBLE) AS word, {short_number('round(o_totalprice, 2)')} AS text FROM orders"


def _movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.col("l_suppkey").cast("string").alias("supplier"),
        F.col("l_returnflag").alias("flag"),
        F.translate(F.format_string("%.2f", "l_extendedprice"), ".", ",").alias("price"),
        F.format_string("-%.2f", "l_discount").alias("discount"),
        F.col("l_quantity").cast("int").cast("string").alias("quantity"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus").alias("_pos"),
    )


_TERMS = (Term("price"), Term("discount", "*", True), Term("quantity", "-"))


def computed_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_totals(_movements(spark, sf_dir), Totals(_TERMS, ("supplier",), name="net")).rows
    return rows.groupBy("supplier").agg(F.count("net").alias("n"), F.bround(F.sum(F.col("net").cast("decimal(28,6)")).cast("double"), 6).alias("net"), F.max("total net").alias("total"))


_MOVES = """
WITH m AS (SELECT CAST(l_suppkey AS VARCHAR) AS supplier, l_returnflag AS flag, CAST(round(l_extendedprice, 2) AS DECIMAL(18,2)) AS price, CAST(round(l_discount, 2) AS DECIMAL(18,2)) AS disc, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
"""
COMPUTED_SQL = _MOVES + "SELECT supplier, count(*) AS n, CAST(sum(price * disc - q) AS DOUBLE) AS net, CAST(sum(price * disc - q) AS DOUBLE) AS total FROM m GROUP BY supplier"


def division_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_totals(_movements(spark, sf_dir), Totals((Term("quantity"), Term("discount", "/", True)), ("flag",))).excluded
    return out.groupBy("reason", "flag").agg(F.count(F.lit(1)).alias("n_rows"))


DIVISION_SQL = _MOVES + "SELECT 'division by zero' AS reason, flag, count(*) AS n_rows FROM m WHERE disc = 0 GROUP BY flag"


def _group_total(function: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        report = apply_totals(_movements(spark, sf_dir), Totals((Term("price"),), ("supplier", "flag"), function)).report
        return report.select("supplier", "flag", "total", "n_rows")

    return run


_TOTAL_SQL = {"sum": "sum(price)", "count": "count(price)", "max": "max(price)", "min": "min(price)", "avg": "round_even(CAST(sum(price) AS DOUBLE) / count(price), 6)"}


def group_total_sql(function: str) -> str:
    return _MOVES + f"SELECT supplier, flag, CAST({_TOTAL_SQL[function]} AS DOUBLE) AS total, count(*) AS n_rows FROM m GROUP BY supplier, flag"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.col("o_custkey").cast("string").alias("cust"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), F.format_string("%.2f", "o_totalprice").alias("price"), F.col("o_orderkey").alias("_pos"))


_ORDERS = """
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS cust, c_mktsegment AS segment, c_nationkey AS nation, CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS price, o_orderkey AS pos FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT *, sum(price) OVER (PARTITION BY cust) AS total FROM o)
"""


def having_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Totals((Term("price"),), ("cust",), condition="single", thresholds=(Threshold(">", 2_500_000),))
    return apply_totals(_orders(spark, sf_dir), spec).rows.select("cust", "price", "value", "total", "threshold")


HAVING_SINGLE_SQL = _ORDERS + "SELECT cust, CAST(price AS VARCHAR) AS price, CAST(price AS DOUBLE) AS value, CAST(total AS DOUBLE) AS total, '> 2500000' AS threshold FROM t WHERE total > 2500000"

_SEGMENTS = (Threshold(">=", 3_000_000, ("BUILDING", "MACHINERY")), Threshold("<", 2_000_000, ("AUTOMOBILE",)))


def having_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Totals((Term("price"),), ("cust",), condition="category", category="segment", thresholds=_SEGMENTS)
    done = apply_totals(_orders(spark, sf_dir), spec)
    kept = done.rows.select("cust", "segment", F.lit("kept").alias("reason"), "threshold")
    return kept.unionByName(done.excluded.select("cust", "segment", "reason", "threshold")).groupBy("cust", "segment", "reason", "threshold").agg(F.count(F.lit(1)).alias("n_rows"))


_CATEGORY = """
c AS (SELECT *, CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN '>= 3000000' WHEN segment = 'AUTOMOBILE' THEN '< 2000000' ELSE '' END AS threshold,
  CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN total >= 3000000 WHEN segment = 'AUTOMOBILE' THEN total < 2000000 END AS ok FROM t)
"""
HAVING_CATEGORY_SQL = _ORDERS + "," + _CATEGORY + """
SELECT cust, segment, CASE WHEN ok THEN 'kept' WHEN ok IS NULL THEN 'category without threshold' ELSE 'group total does not meet the threshold' END AS reason, threshold, count(*) AS n_rows FROM c GROUP BY ALL
"""


def having_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Nations are compared as numbers: "01" is nation 1.
    spec = Totals((Term("price"),), ("cust",), condition="category", category="nation", thresholds=(Threshold(">", 2_000_000, ("01", "2.0", "3")),), others="pass")
    return apply_totals(_orders(spark, sf_dir), spec).report


HAVING_OTHERS_SQL = _ORDERS + """
SELECT cust, CAST(nation AS VARCHAR) AS category, CAST(total AS DOUBLE) AS total, CASE WHEN nation IN (1, 2, 3) THEN '> 2000000' ELSE '' END AS threshold,
       CASE WHEN nation NOT IN (1, 2, 3) OR total > 2000000 THEN 'yes' ELSE 'no' END AS passes, count(*) AS n_rows FROM t GROUP BY ALL
"""


def totals_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Totals((Term("price"),), ("cust",), "avg", "single", thresholds=(Threshold("<=", 200_000),), name="price")
    return apply_totals(_orders(spark, sf_dir), spec).report


TOTALS_REPORT_SQL = _ORDERS + "SELECT cust, round_even(CAST(sum(price) AS DOUBLE) / count(*), 6) AS \"total price\", '<= 200000' AS threshold, CASE WHEN round_even(CAST(sum(price) AS DOUBLE) / count(*), 6) <= 200000 THEN 'yes' ELSE 'no' END AS passes, count(*) AS n_rows FROM o GROUP BY cust"


def _summary(companions: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        moves = _movements(spark, sf_dir).drop("discount")
        return apply_totals(moves, Totals((Term("price"),), ("supplier",), output="summary", companions=companions, show=())).rows

    return run


_SUMMARY_ORDER = "ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus"
_TEXT = {"flag": "l_returnflag", "price": "replace(printf('%.2f', l_extendedprice), '.', ',')", "quantity": "CAST(CAST(l_quantity AS INT) AS VARCHAR)"}


def summary_sql(companions: str) -> str:
    cells = {
        "sum": f"first(l_returnflag {_SUMMARY_ORDER}) AS flag, CAST(sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))) AS DOUBLE) AS price, CAST(sum(CAST(l_quantity AS INT)) AS DOUBLE) AS quantity",
        "first": ", ".join(f"first({e} {_SUMMARY_ORDER}) AS {n}" for n, e in _TEXT.items()),
        "last": ", ".join(f"last({e} {_SUMMARY_ORDER}) AS {n}" for n, e in _TEXT.items()),
        "distinct": ", ".join(f"count(DISTINCT {e}) AS {n}" for n, e in _TEXT.items()),
    }[companions]
    return f"SELECT CAST(l_suppkey AS VARCHAR) AS supplier, {cells}, CAST(sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS group_rows FROM lineitem GROUP BY l_suppkey"


QUERIES = {
    "q_filter_eq_numeric": (_kept(Filter("size", "==", ("7", "12.0"), "keep")), _PARTS + "SELECT p_partkey FROM p WHERE size IN (7, 12)"),
    "q_filter_eq_text": (_kept(Filter("brand", "==", ("Brand#1", "Brand#2", "Brand#12"), "keep", False)), _PARTS + "SELECT p_partkey FROM p WHERE trim(brand) IN ('Brand#1', 'Brand#2', 'Brand#12')"),
    "q_filter_ne_nulls": (_kept(Filter("brand", "!=", ("Brand#1",), "keep", False)), _PARTS + "SELECT p_partkey FROM p WHERE coalesce(trim(brand), '') <> 'Brand#1'"),
    "q_filter_range": (_kept(Filter("size", "<", ("10",), "drop")), _PARTS + "SELECT p_partkey FROM p WHERE size >= 10"),
    "q_filter_contains": (_kept(Filter("type", "contains", ("St", "oP"), "keep")), _PARTS + "SELECT p_partkey FROM p WHERE type ILIKE '%st%' OR type ILIKE '%op%'"),
    "q_filter_blank": (_kept(Filter("brand", "blank", (), "keep")), _PARTS + "SELECT p_partkey FROM p WHERE coalesce(trim(brand), '') = ''"),
    "q_filter_not_blank": (_kept(Filter("brand", "not blank", (), "keep")), _PARTS + "SELECT p_partkey FROM p WHERE coalesce(trim(brand), '') <> ''"),
    "q_filter_chain_reason": (filter_chain, CHAIN_SQL),
    "q_key_forms": (key_forms, KEY_FORMS_SQL),
    "q_parse_number_locales": (parse_locales, PARSE_SQL),
    "q_computed_column": (computed_column, COMPUTED_SQL),
    "q_div_zero_excluded": (division_excluded, DIVISION_SQL),
    **{f"q_group_total_{f}": (_group_total(f), group_total_sql(f)) for f in _TOTAL_SQL},
    "q_having_single": (having_single, HAVING_SINGLE_SQL),
    "q_having_category": (having_category, HAVING_CATEGORY_SQL),
    "q_having_others": (having_others, HAVING_OTHERS_SQL),
    "q_totals_report": (totals_report, TOTALS_REPORT_SQL),
    **{f"q_summarise_{c}": (_summary(c), summary_sql(c)) for c in ("sum", "first", "last", "distinct")},
}
