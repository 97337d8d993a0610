"""A fixed-width file rendered from orders and customers, with faults, read, validated, completed and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.plans.fixtures import table
from cotejo.spec.layout import Field, Layout, Record, Rule
from cotejo.spec.readers import Parsed, parse_delimited, parse_fixed, table_of
from cotejo.spec.rules import violations
from cotejo.spec.validate import validate
from cotejo.spec.writers import complete, render_lines

_HEAD = Record("01", fields=(Field("kind", "constant", 1, 2, constant="01"), Field("day", "date", 3, 8, date_mask="AAAAMMDD"), Field("rest", "text", 11, 50, required=False)), place="first")
_CUST = Record("03", fields=(Field("kind", "constant", 1, 2, constant="03"), Field("cust", "integer", 3, 10), Field("segment", "text", 13, 10), Field("rest", "text", 23, 38, required=False)), most=None)
_ORDER = Record(
    "02",
    fields=(
        Field("kind", "constant", 1, 2, constant="02"), Field("id", "integer", 3, 10), Field("day", "date", 13, 8, date_mask="AAAAMMDD"), Field("status", "text", 21, 1, allowed=("F", "O", "P")),
        Field("price", "decimal", 22, 15, decimals=2), Field("priority", "text", 37, 14, required=False), Field("cust", "integer", 51, 10),
    ),
    most=None,
)
_TAIL = Record("09", fields=(Field("kind", "constant", 1, 2, constant="09"), Field("n_orders", "integer", 3, 10), Field("total", "decimal", 13, 18, decimals=2), Field("rest", "text", 31, 30, required=False)), place="last")
RULES = (
    Rule("R1", "price > 5000", "record", "02", "price above 5000"),
    Rule("R2", 'valor("09", "n_orders") == contar("02")', "file", None, "orders are counted"),
    Rule("R3", 'valor("09", "total") == sumar("02", "price")', "file", None, "prices are summed"),
    Rule("R4", 'implica(status == "F", longitud(priority) > 5)', "record", "02", "priority of final orders"),
    Rule("R5", 'existe("03", "cust", cust)', "record", "02", "customer is listed"),
    Rule("R6", 'sumar("02", "price", "cust", cust, "status", "F") <= 1000000', "record", "03", "final orders of a customer"),
    Rule("R7", 'contar("02", "cust", cust) >= 3 or segment in ["BUILDING", "MACHINERY"]', "record", "03", "few orders"),
    Rule("R8", 'day <= valor("01", "day")', "record", "02", "order before the file's day"),
)
LAYOUT = Layout("orders", "fixed", (_HEAD, _CUST, _ORDER, _TAIL), RULES, line_length=60)
DELIMITED = Layout("orders", "delimited", (Record("P", fields=(Field("id", "integer", length=10), Field("day", "date", length=10, date_mask="DD/MM/AAAA"), Field("price", "decimal", length=14, decimals=2), Field("status", "text", length=1, allowed=("F", "O")))),), separator=";")

_ORDER_LINE = """
concat('02', lpad(cast(o_orderkey AS string), 10, '0'), CASE WHEN o_orderkey % 100 = 3 THEN '20240231' ELSE date_format(o_orderdate, 'yyyyMMdd') END,
  CASE WHEN o_orderkey % 100 = 13 THEN 'X' ELSE o_orderstatus END,
  CASE WHEN o_orderkey % 100 = 7 THEN '00000000012A.00' ELSE lpad(cast(cast(round(o_totalprice * 100) AS bigint) AS string), 15, '0') END,
  rpad(CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE substring(o_orderpriority, 1, 14) END, 14, ' '), lpad(cast(o_custkey AS string), 10, '0'), CASE WHEN o_orderkey % 100 = 9 THEN '!' ELSE '' END)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, value): header, customers but every tenth, orders, trailer with a total that is 1 off."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 10_000_000).alias("line"), F.expr(_ORDER_LINE).alias("value"))
    c = table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 4").select((F.col("c_custkey") + 2).alias("line"), F.expr("rpad(concat('03', lpad(cast(c_custkey AS string), 10, '0'), rpad(c_mktsegment, 10, ' ')), 60, ' ')").alias("value"))
    head = spark.range(1).select(F.lit(1).cast("long").alias("line"), F.rpad(F.lit("0120000101"), 60, " ").alias("value"))
    tail = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.expr("cast(round(o_totalprice * 100) AS bigint)")) + 100).alias("t"))
    tail = tail.select(F.lit(10**12).alias("line"), F.expr("rpad(concat('09', lpad(cast(n AS string), 10, '0'), lpad(cast(t AS string), 18, '0')), 60, ' ')").alias("value"))
    odd = spark.range(1).select(F.lit(9_999_999).cast("long").alias("line"), F.rpad(F.lit("05"), 60, " ").alias("value"))
    return head.unionByName(c).unionByName(odd).unionByName(o).unionByName(tail)


def parsed(spark: SparkSession, sf_dir: str) -> Parsed:
    return parse_fixed(lines(spark, sf_dir), LAYOUT)


def fixed_width_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parsed(spark, sf_dir).frames["02"]
    return df.select(F.col("_line").alias("line"), F.col("id").cast("long").alias("id"), F.date_format("day", "yyyy-MM-dd").alias("day"), "status", F.col("price").cast("double").alias("price"), "priority", F.col("cust").cast("long").alias("cust"))


_O = """
o AS (SELECT o_orderkey AS id, o_orderkey + 10000000 AS line, CASE WHEN o_orderkey % 100 <> 3 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 100 <> 13 THEN o_orderstatus END AS status,
        CASE WHEN o_orderkey % 100 <> 7 THEN CAST(round(o_totalprice * 100) AS BIGINT) / 100 END AS price, CASE WHEN o_orderkey % 9 <> 0 THEN rtrim(substr(o_orderpriority, 1, 14)) END AS priority, o_custkey AS cust
      FROM orders WHERE o_orderkey % 100 <> 9),
c AS (SELECT c_custkey AS cust, c_custkey + 2 AS line, c_mktsegment AS segment FROM customer WHERE c_custkey % 10 <> 4)
"""
PARSE_SQL = f"WITH {_O} SELECT line, id, strftime(day, '%Y-%m-%d') AS day, status, price, priority, cust FROM o"


def field_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parsed(spark, sf_dir).frames["02"]
    return df.select(F.col("_line").alias("line"), F.explode("_errors").alias("e")).select("line", "e.field", "e.message")


FIELD_ERRORS_SQL = """
SELECT o_orderkey + 10000000 AS line, 'day' AS field, '''20240231'' is no date AAAAMMDD' AS message FROM orders WHERE o_orderkey % 100 = 3
UNION ALL SELECT o_orderkey + 10000000, 'status', '''X'' is not one of F, O, P' FROM orders WHERE o_orderkey % 100 = 13
UNION ALL SELECT o_orderkey + 10000000, 'price', '''00000000012A.00'' has other characters than digits' FROM orders WHERE o_orderkey % 100 = 7
"""


def _rule(rule_id: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = next(r for r in RULES if r.id == rule_id)
        return violations(rule, LAYOUT, parsed(spark, sf_dir).frames, spark).select(F.col("_line").alias("line"))

    return run


_RULE_SQL = {
    "R1": "SELECT line FROM o WHERE price <= 5000",
    "R2": "SELECT 0::BIGINT AS line WHERE (SELECT count(*) FROM orders) <> (SELECT count(*) FROM o)",
    "R3": "SELECT 0::BIGINT AS line WHERE (SELECT sum(CAST(round(o_totalprice * 100) AS BIGINT)) + 100 FROM orders) <> (SELECT sum(CAST(round(price * 100) AS BIGINT)) FROM o)",
    "R4": "SELECT line FROM o WHERE status = 'F' AND length(priority) <= 5",
    "R5": "SELECT line FROM o WHERE cust NOT IN (SELECT cust FROM c)",
    "R6": "SELECT c.line FROM c JOIN o ON o.cust = c.cust AND o.status = 'F' GROUP BY c.line HAVING sum(CAST(round(price * 100) AS BIGINT)) > 100000000",
    "R7": "SELECT c.line FROM c LEFT JOIN o ON o.cust = c.cust WHERE segment NOT IN ('BUILDING', 'MACHINERY') GROUP BY c.line HAVING count(o.cust) < 3",
    "R8": "SELECT line FROM o WHERE day > DATE '2000-01-01'",
}
_RULE_NAMES = {"R1": "record", "R2": "count", "R3": "sum", "R4": "implies", "R5": "exists", "R6": "correlated_sum", "R7": "correlated_count", "R8": "unique_value"}


def validation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(parsed(spark, sf_dir), LAYOUT, spark).groupBy("severity", "origin", "record_type", "field", "rule").agg(F.count(F.lit(1)).alias("n_findings"), F.min("line").alias("first_line"))


def _findings_sql() -> str:
    rules = [f"SELECT 'rule' AS origin, {repr(r.record) if r.scope == 'record' else 'NULL'} AS record_type, NULL AS field, '{r.id}' AS rule, {'line' if r.scope == 'record' else 'NULL'} AS line FROM ({_RULE_SQL[r.id]})" for r in RULES]
    return f"""
WITH {_O}, e AS ({FIELD_ERRORS_SQL}),
f AS (
  SELECT 'structure' AS origin, NULL AS record_type, NULL AS field, NULL AS rule, o_orderkey + 10000000 AS line FROM orders WHERE o_orderkey % 100 = 9
  UNION ALL SELECT 'structure', NULL, NULL, NULL, 9999999
  UNION ALL SELECT 'field', '02', field, NULL, line FROM e
  UNION ALL {' UNION ALL '.join(rules)})
SELECT 'error' AS severity, origin, record_type, field, rule, count(*) AS n_findings, min(line) AS first_line FROM f GROUP BY ALL
"""


def delimited_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat_ws(';', cast(o_orderkey AS string), date_format(o_orderdate, 'dd/MM/yyyy'), CASE WHEN o_orderkey % 50 = 5 THEN '12.345' ELSE format_string('%.2f', o_totalprice) END, o_orderstatus, CASE WHEN o_orderkey % 40 = 1 THEN 'more' END)"
    p = parse_delimited(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"), F.expr(text).alias("value")), DELIMITED)
    good = table_of(p, DELIMITED.records[0]).select(F.col("_pos").alias("line"), "id", "day", "price", "status", F.lit(None).cast("string").alias("fault"))
    return good.unionByName(p.structure.select("line", F.col("message").alias("fault")), allowMissingColumns=True)


DELIMITED_SQL = """
SELECT o_orderkey AS line, CASE WHEN o_orderkey % 40 <> 1 THEN CAST(o_orderkey AS VARCHAR) END AS id, CASE WHEN o_orderkey % 40 <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
       CASE WHEN o_orderkey % 40 <> 1 AND o_orderkey % 50 <> 5 THEN regexp_replace(regexp_replace(printf('%.2f', o_totalprice), '0+$', ''), '\\.$', '') END AS price,
       CASE WHEN o_orderkey % 40 <> 1 AND o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS status,
       CASE WHEN o_orderkey % 40 = 1 THEN 'the line has 5 fields; record P has 4' END AS fault FROM orders
"""


def _blank(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    frames = dict(parse_fixed(lines(spark, sf_dir).filter("line <> 9999999"), LAYOUT).frames)
    frames = {k: v.drop("_errors") for k, v in frames.items()}
    frames["09"] = frames["09"].withColumn("n_orders", F.lit(None).cast("decimal(10,0)")).withColumn("total", F.lit(None).cast("decimal(18,2)"))
    return frames


def autocomplete_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = complete(_blank(spark, sf_dir), LAYOUT, spark)["09"]
    return done.select(F.col("n_orders").cast("long").alias("n_orders"), F.col("total").cast("double").alias("total"))


AUTOCOMPLETE_SQL = f"WITH {_O} SELECT count(*) AS n_orders, CAST(sum(CAST(round(price * 100) AS BIGINT)) / 100 AS DOUBLE) AS total FROM o"


def fixed_width_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean records are rendered again: the text must be the one that was read."""
    frames = parsed(spark, sf_dir).frames
    clean = {k: v.filter(F.size("_errors") == 0).drop("_errors") for k, v in frames.items()}
    return render_lines(clean, LAYOUT).select("line", "code", "value")


WRITE_SQL = """
SELECT 1::BIGINT AS line, '01' AS code, rpad('0120000101', 60, ' ') AS value
UNION ALL SELECT c_custkey + 2, '03', rpad('03' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || c_mktsegment, 60, ' ') FROM customer WHERE c_custkey % 10 <> 4
UNION ALL SELECT o_orderkey + 10000000, '02', '02' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || strftime(o_orderdate, '%Y%m%d') || o_orderstatus || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), 15, '0')
  || rpad(CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE substr(o_orderpriority, 1, 14) END, 14, ' ') || lpad(CAST(o_custkey AS VARCHAR), 10, '0') FROM orders WHERE o_orderkey % 100 NOT IN (3, 7, 9, 13)
UNION ALL SELECT 1000000000000, '09', rpad('09' || lpad(CAST(count(*) AS VARCHAR), 10, '0') || lpad(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) + 100 AS VARCHAR), 18, '0'), 60, ' ') FROM orders
"""

QUERIES = {
    "q_fixed_width_parse": (fixed_width_parse, PARSE_SQL),
    "q_field_errors": (field_errors, FIELD_ERRORS_SQL),
    "q_delimited_parse": (delimited_parse, DELIMITED_SQL),
    **{f"q_rule_{n}": (_rule(r), f"WITH {_O} {_RULE_SQL[r]}") for r, n in _RULE_NAMES.items()},
    "q_validation_findings": (validation_findings, _findings_sql()),
    "q_autocomplete_totals": (autocomplete_totals, AUTOCOMPLETE_SQL),
    "q_fixed_width_write": (fixed_width_write, WRITE_SQL),
}
