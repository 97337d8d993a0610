"""Reconciliation, lookups and controls over orders, customers and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions.text import key_form
from cotejo.operators.controls import Control, control_counts, control_failures
from cotejo.operators.filters import Filter
from cotejo.operators.lookup import FOUND, Lookup, apply_lookups, match_rates
from cotejo.operators.pairs import PairResult, reconcile_pair
from cotejo.operators.reconcile import Group, GroupFile, Reconciliation, build, group_statistics, per_key, reconcile
from cotejo.plans.fixtures import SIDES_SQL, bank, ledger, position, short_number, table


def two_groups(spark: SparkSession, sf_dir: str) -> Reconciliation:
    groups = [
        Group("ledger", (GroupFile("ledger", ledger(spark, sf_dir), ("key",), "digits"),)),
        Group("bank", (GroupFile("bank", bank(spark, sf_dir), ("ref",), "digits", (Filter("status", "==", ("VOID",)),)),)),
    ]
    return reconcile(groups, [("amount", "amount")], 0.01)


def two_group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_groups(spark, sf_dir).matrix


_MATRIX_SQL = f"""
WITH {SIDES_SQL},
l AS (SELECT CAST(k AS VARCHAR) AS key, count(*) AS n, sum(amount) AS v FROM ledger GROUP BY k),
b AS (SELECT CAST(k AS VARCHAR) AS key, count(*) AS n, sum(amount) AS v FROM bank WHERE status <> 'VOID' GROUP BY k),
m AS (
  SELECT coalesce(l.key, b.key) AS key, l.key IS NOT NULL AS in_ledger, coalesce(l.n, 0) AS rows_ledger, b.key IS NOT NULL AS in_bank, coalesce(b.n, 0) AS rows_bank,
         CAST(l.v AS DOUBLE) AS ledger__amount, CAST(b.v AS DOUBLE) AS bank__amount, abs(l.v - b.v) AS gap
  FROM l FULL JOIN b ON l.key = b.key),
r AS (
  SELECT key, in_ledger, rows_ledger, in_bank, rows_bank, ledger__amount, bank__amount, in_ledger AND in_bank AS in_all,
         CASE WHEN in_ledger AND in_bank THEN 'in all' WHEN in_ledger THEN 'only in ledger' ELSE 'only in bank' END AS state,
         CASE WHEN gap > 0.01 THEN 'ledger.amount=' || {short_number('ledger__amount')} || ' vs bank.amount=' || {short_number('bank__amount')} || ' (diff. ' || {short_number('gap')} || ')' ELSE '' END AS differences
  FROM m)
"""
TWO_GROUP_SQL = _MATRIX_SQL + "SELECT *, differences <> '' AS has_diff FROM r"


def difference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_groups(spark, sf_dir).differences


DIFFERENCE_SQL = _MATRIX_SQL + "SELECT key, differences FROM r WHERE differences <> ''"


def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_groups(spark, sf_dir).summary()


SUMMARY_SQL = _MATRIX_SQL + """
SELECT count(*) AS universe, count(*) FILTER (in_all) AS in_all, count(*) FILTER (differences <> '') AS in_all_diff,
       count(*) FILTER (in_all AND differences = '') AS in_all_equal, '0.01' AS tolerance,
       count(*) FILTER (state = 'only in ledger') AS only_in_ledger, count(*) FILTER (in_all) || ' of ' || count(*) FILTER (in_ledger) AS coverage_ledger,
       count(*) FILTER (state = 'only in bank') AS only_in_bank, count(*) FILTER (in_all) || ' of ' || count(*) FILTER (in_bank) AS coverage_bank FROM r
"""


def excluded_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_groups(spark, sf_dir).excluded.groupBy("group", "file", "reason").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))


EXCLUDED_SQL = f"WITH {SIDES_SQL} SELECT 'bank' AS \"group\", 'bank' AS file, 'drop status is VOID' AS reason, count(*) AS n_rows, CAST(sum(amount) AS DOUBLE) AS amount FROM bank WHERE status = 'VOID'"


def three_groups(spark: SparkSession, sf_dir: str) -> Reconciliation:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), position("o_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("ref"), F.col("l_quantity").cast("string").alias("qty"), position("l_orderkey", "l_linenumber"))
    events = table(spark, sf_dir, "events").select(F.format_string("%08d", "event_id").alias("k"), position("event_id"))
    groups = [
        Group("orders", (GroupFile("orders", orders, ("id",), "no_zeros"),)),
        Group("lines", (GroupFile("lines", lines, ("ref",), "no_zeros"),), amounts=("qty",)),
        Group("events", (GroupFile("events", events, ("k",), "no_zeros"),)),
    ]
    return reconcile(groups)


def three_group_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return three_groups(spark, sf_dir).matrix.groupBy("state").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("rows_lines").alias("rows_lines"), F.bround(F.sum("lines__qty"), 2).alias("qty"))


THREE_GROUP_SQL = """
WITH u AS (
  SELECT o_orderkey AS k, 1 AS o, 0 AS l, 0 AS e, 0 AS q FROM orders UNION ALL
  SELECT l_orderkey, 0, 1, 0, l_quantity FROM lineitem UNION ALL SELECT event_id, 0, 0, 1, 0 FROM events),
m AS (SELECT k, sum(o) > 0 AS o, sum(l) > 0 AS l, sum(e) > 0 AS e, sum(l) AS rows_lines, sum(q) AS q FROM u GROUP BY k)
SELECT CASE WHEN o AND l AND e THEN 'in all' ELSE 'only in ' || concat_ws(' + ', CASE WHEN o THEN 'orders' END, CASE WHEN l THEN 'lines' END, CASE WHEN e THEN 'events' END) END AS state,
       count(*) AS n_keys, CAST(sum(rows_lines) AS BIGINT) AS rows_lines, CASE WHEN bool_or(l) THEN round(sum(q), 2) END AS qty FROM m GROUP BY ALL
"""


def _per_order(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").cast("string").alias("id"), F.format_string("%.2f", column).alias("rate"), position("l_orderkey", "l_linenumber", column))


def unique_value_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = [Group(n, (GroupFile(n, _per_order(spark, sf_dir, c), ("id",)),)) for n, c in (("tax", "l_tax"), ("discount", "l_discount"))]
    return reconcile(groups, [("rate", "rate")], functions=["unique"]).matrix.select("key", "tax__rate", "discount__rate", "differences", "has_diff")


def _unique_sql() -> str:
    def cell(g: str) -> str:
        return f"'{g}.rate=' || CASE WHEN {g}_lo <> {g}_hi THEN 'several values (' || {short_number(g + '_lo')} || ' to ' || {short_number(g + '_hi')} || ')' ELSE {short_number(g + '_lo')} END"

    return f"""
WITH m AS (SELECT CAST(l_orderkey AS VARCHAR) AS key, min(round(l_tax, 2)) AS tax_lo, max(round(l_tax, 2)) AS tax_hi, min(round(l_discount, 2)) AS discount_lo, max(round(l_discount, 2)) AS discount_hi FROM lineitem GROUP BY l_orderkey),
v AS (SELECT *, CASE WHEN tax_lo = tax_hi THEN tax_lo END AS tax__rate, CASE WHEN discount_lo = discount_hi THEN discount_lo END AS discount__rate FROM m),
t AS (SELECT key, tax__rate, discount__rate, CASE
  WHEN tax__rate IS NULL OR discount__rate IS NULL THEN {cell('tax')} || ' vs ' || {cell('discount')}
  WHEN abs(tax__rate - discount__rate) > 1e-9 THEN 'tax.rate=' || {short_number('tax__rate')} || ' vs discount.rate=' || {short_number('discount__rate')} || ' (diff. ' || {short_number('abs(tax__rate - discount__rate)')} || ')'
  ELSE '' END AS differences FROM v)
SELECT *, differences <> '' AS has_diff FROM t
"""


def pair_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, PairResult]:
    a = table(spark, sf_dir, "customer").select(F.format_string("%06d", "c_custkey").alias("code"), F.col("c_nationkey").cast("string").alias("nation"), F.format_string("%.2f", "c_acctbal").alias("balance"), position("c_custkey"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 17).cast("string").alias("ref"), F.col("s_nationkey").cast("string").alias("country"), F.translate(F.format_string("%.2f", "s_acctbal"), ".", ",").alias("saldo"), position("s_suppkey"))
    b = b.unionByName(b.filter("cast(ref AS int) < 200").withColumn("_pos", F.struct((F.col("_pos.s_suppkey") + 1_000_000).alias("s_suppkey"))))
    return a, b, reconcile_pair(a, b, ["code"], ["ref"], [("nation", "country"), ("balance", "saldo")], "0.01")


def _pair(spark: SparkSession, sf_dir: str) -> PairResult:
    return pair_sides(spark, sf_dir)[2]


_PAIR_SQL = """
WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS k, printf('%06d', c_custkey) AS code, CAST(c_nationkey AS VARCHAR) AS nation, printf('%.2f', c_acctbal) AS balance FROM customer),
b0 AS (SELECT s_suppkey, CAST(s_suppkey * 17 AS VARCHAR) AS ref, CAST(s_nationkey AS VARCHAR) AS country, replace(printf('%.2f', s_acctbal), '.', ',') AS saldo FROM supplier),
b AS (SELECT s_suppkey AS p, ref AS k, ref, country, saldo FROM b0 UNION ALL SELECT s_suppkey + 1000000, ref, ref, country, saldo FROM b0 WHERE CAST(ref AS INT) < 200),
b1 AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY p) = 1)
"""


def two_way_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _pair(spark, sf_dir).matched
    return m.select("key", F.col("`A.nation`").alias("nation"), F.col("`B.country`").alias("country"), F.col("`A.balance`").alias("balance"), F.col("`B.saldo`").alias("saldo"), F.expr("differences <> ''").alias("differs"))


TWO_WAY_SQL = _PAIR_SQL + "SELECT a.k AS key, nation, country, balance, saldo, CAST(nation AS INT) <> CAST(country AS INT) OR abs(CAST(balance AS DECIMAL(18,2)) - CAST(replace(saldo, ',', '.') AS DECIMAL(18,2))) > 0.01 AS differs FROM a JOIN b1 USING (k)"


def only_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(spark, sf_dir).only_a.drop("_pos")


def only_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(spark, sf_dir).only_b.drop("_pos")


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(spark, sf_dir).duplicates_b.drop("_pos")


ONLY_LEFT_SQL = _PAIR_SQL + "SELECT code, nation, balance FROM a WHERE k NOT IN (SELECT k FROM b)"
ONLY_RIGHT_SQL = _PAIR_SQL + "SELECT ref, country, saldo FROM b WHERE k NOT IN (SELECT k FROM a)"
DUPLICATES_SQL = _PAIR_SQL + "SELECT ref, country, saldo FROM b QUALIFY count(*) OVER (PARTITION BY k) > 1"


def _lookups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Lookup]]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%010d", "o_custkey").alias("cust"), position("o_orderkey"))
    base = orders.withColumn("_key", key_form("cust", "no_zeros"))
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("_key"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"), F.struct(F.lit(0).alias("d"), "c_custkey").alias("_pos")).filter("cast(_key AS bigint) % 7 <> 3")
    cust = cust.unionByName(cust.select("_key", F.lit("SECOND").alias("c_mktsegment"), "nation", F.struct(F.lit(1).alias("d"), "_pos.c_custkey").alias("_pos")))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("_key"), "n_name", F.col("n_regionkey").cast("string").alias("region"), position("n_nationkey"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("_key"), "r_name", position("r_regionkey"))
    # Given in reverse: the order follows from what each needs.
    return base, [Lookup("region", region, ("r_name",), ("region",)), Lookup("nation", nation, ("n_name", "region"), ("nation",)), Lookup("customer", cust, ("c_mktsegment", "nation"))]


def lookup_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, lookups = _lookups(spark, sf_dir)
    return apply_lookups(base, lookups[2:]).select("o_orderkey", "cust", "c_mktsegment", F.col(FOUND + "customer").alias("found"))


def lookup_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, lookups = _lookups(spark, sf_dir)
    return apply_lookups(base, lookups).select("o_orderkey", "c_mktsegment", "n_name", "r_name")


def lookup_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, lookups = _lookups(spark, sf_dir)
    return match_rates(apply_lookups(base, lookups), lookups)


LOOKUP_DEDUP_SQL = "SELECT o_orderkey, printf('%010d', o_custkey) AS cust, c_mktsegment, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 3) ON c_custkey = o_custkey"
LOOKUP_CHAINED_SQL = "SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 3) ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"
LOOKUP_RATE_SQL = f"WITH j AS ({LOOKUP_CHAINED_SQL}), c AS (SELECT 'customer' AS lookup, count(c_mktsegment) AS n_found, count(*) AS n_rows FROM j UNION ALL SELECT 'nation', count(n_name), count(*) FROM j UNION ALL SELECT 'region', count(r_name), count(*) FROM j) SELECT *, printf('%d of %d (%.1f%%)', n_found, n_rows, 100.0 * n_found / n_rows) AS rate FROM c"


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_quantity") % 10 != 0, F.translate(F.format_string("%05.2f", "l_tax"), ".", ",")).alias("told"),
        F.when(F.col("l_quantity") % 7 == 0, F.lit("")).when(F.col("l_quantity") % 7 == 1, F.lit(" n a ")).otherwise(F.format_string("%.3f", "l_discount")).alias("due"),
        F.col("l_orderkey").cast("string").alias("_key"),
    )


def control_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control_counts(_rates(spark, sf_dir), Control("told", "due", 0.01))


def control_failed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control_failures(_rates(spark, sf_dir), [Control("told", "due", 0.01, "rate")], "lines").groupBy("group", "control", "state", "key").agg(F.count(F.lit(1)).alias("n_rows"))


_RATES_SQL = """
WITH l AS (SELECT l_orderkey, CASE WHEN l_quantity % 10 <> 0 THEN round(l_tax, 2) END AS told,
  CASE WHEN l_quantity % 7 = 0 THEN NULL WHEN l_quantity % 7 = 1 THEN -1 ELSE round(l_discount, 3) END AS due FROM lineitem),
s AS (SELECT *, CASE WHEN told IS NULL OR due IS NULL THEN 'no data' WHEN due >= 0 AND abs(told - due) <= 0.01 + 1e-9 THEN 'match' ELSE 'differs' END AS state FROM l)
"""
CONTROL_SQL = _RATES_SQL + "SELECT state, count(*) AS n_rows FROM s GROUP BY state"
CONTROL_FAILED_SQL = _RATES_SQL + "SELECT 'lines' AS \"group\", 'control rate' AS control, state, CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n_rows FROM s WHERE state <> 'match' GROUP BY ALL"


def _status_files(spark: SparkSession, sf_dir: str) -> Group:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("if(o_orderkey % 50 = 7, '  ', cast(o_custkey AS string))").alias("cust"), "o_orderstatus", F.format_string("%.2f", "o_totalprice").alias("price"), position("o_orderkey"))
    parts = [o.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in "FOP"]
    parts[1] = parts[1].drop("price")
    return Group("orders", tuple(GroupFile(s, p, ("cust",)) for s, p in zip("FOP", parts)))


def concat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(_status_files(spark, sf_dir)).detail.select("o_orderkey", "cust", "price", F.col("_file").alias("file"))


CONCAT_SQL = "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS cust, CASE WHEN o_orderstatus <> 'O' THEN printf('%.2f', o_totalprice) END AS price, o_orderstatus AS file FROM orders WHERE o_orderkey % 50 <> 7"


def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_statistics(build(_status_files(spark, sf_dir)))


GROUP_STATS_SQL = """
WITH k AS (SELECT CASE WHEN o_orderkey % 50 = 7 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_repeated_rows, CAST(coalesce(sum(n) FILTER (k = ''), 0) AS BIGINT) AS n_empty_keys FROM k
"""


def per_key_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("_key"),
        F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("flag"),
        F.format_string("%.2f", "l_extendedprice").alias("price"),
        F.format_string("%.2f", "l_tax").alias("tax"),
        position("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    )
    return per_key(l, ["price"], ["tax"]).select(F.col("_key").alias("key"), "flag", "price", "tax", F.col("_several tax").alias("several_tax"), F.col("_rows").alias("n_rows"))


PER_KEY_SQL = f"""
SELECT CAST(l_orderkey AS VARCHAR) AS key,
       first(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) FILTER (l_linenumber > 1) AS flag,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, CASE WHEN min(round(l_tax, 2)) = max(round(l_tax, 2)) THEN min(round(l_tax, 2)) END AS tax,
       CASE WHEN min(round(l_tax, 2)) <> max(round(l_tax, 2)) THEN {short_number('min(round(l_tax, 2))')} || ' to ' || {short_number('max(round(l_tax, 2))')} ELSE '' END AS several_tax, count(*) AS n_rows
FROM lineitem GROUP BY l_orderkey
"""

QUERIES = {
    "q_nway_two_group_matrix": (two_group_matrix, TWO_GROUP_SQL),
    "q_difference_rows": (difference_rows, DIFFERENCE_SQL),
    "q_reconcile_summary": (reconcile_summary, SUMMARY_SQL),
    "q_excluded_audit": (excluded_audit, EXCLUDED_SQL),
    "q_nway_three_group_states": (three_group_states, THREE_GROUP_SQL),
    "q_unique_value_compare": (unique_value_compare, _unique_sql()),
    "q_two_way_reconcile": (two_way_reconcile, TWO_WAY_SQL),
    "q_only_left": (only_left, ONLY_LEFT_SQL),
    "q_only_right": (only_right, ONLY_RIGHT_SQL),
    "q_duplicates": (duplicates, DUPLICATES_SQL),
    "q_lookup_dedup": (lookup_dedup, LOOKUP_DEDUP_SQL),
    "q_lookup_chained": (lookup_chained, LOOKUP_CHAINED_SQL),
    "q_lookup_match_rate": (lookup_match_rate, LOOKUP_RATE_SQL),
    "q_control_states": (control_states, CONTROL_SQL),
    "q_control_failures": (control_failed_rows, CONTROL_FAILED_SQL),
    "q_concat_files": (concat_files, CONCAT_SQL),
    "q_group_stats": (group_stats, GROUP_STATS_SQL),
    "q_per_key_reduce": (per_key_reduce, PER_KEY_SQL),
}
