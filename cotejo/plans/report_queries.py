"""Key strength and pair ranking, two-way summary, views of states, sums by key, further rules, delimited output, cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.operators.keys import distinct_values, key_strength, name_ratio, pair_ranking
from cotejo.operators.reconcile import Group, GroupFile, reconcile
from cotejo.plans import cases
from cotejo.plans.fixtures import SIDES_SQL, bank, ledger, position, table
from cotejo.plans.reconcile_queries import _MATRIX_SQL, _PAIR_SQL, pair_sides, two_groups
from cotejo.plans.spec_queries import _O, DELIMITED, LAYOUT, parsed
from cotejo.plans.usage_queries import _SIDES
from cotejo.spec.layout import Rule
from cotejo.spec.rules import violations
from cotejo.spec.writers import records_from, render_lines


def key_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ledger(spark, sf_dir), bank(spark, sf_dir)
    rows = [(form, round(key_strength(a, ["key"], b, ["ref"], form), 6)) for form in ("exact", "digits")]
    return spark.createDataFrame(rows, "form string, strength double")


KEY_STRENGTH_SQL = f"""
WITH {SIDES_SQL},
l AS (SELECT count(DISTINCT k)::DOUBLE AS d, count(*) AS n FROM ledger), b AS (SELECT count(DISTINCT k)::DOUBLE AS d, count(*) AS n FROM bank),
s AS (SELECT count(*)::DOUBLE AS c FROM (SELECT k FROM ledger INTERSECT SELECT k FROM bank))
SELECT 'exact' AS form, 0::DOUBLE AS strength UNION ALL
SELECT 'digits', round(s.c / least(l.d, b.d) * least(1::DOUBLE, 2 * l.d / l.n, 2 * b.d / b.n), 6) FROM l, b, s
"""


def pair_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_ranking(ledger(spark, sf_dir), bank(spark, sf_dir)).select("left", "right", "score")


_ALIKE = " ".join(f"WHEN l = '{x}' AND r = '{y}' THEN {name_ratio(x, y)}" for x in ("key", "amount") for y in ("ref", "amount", "status"))
PAIR_RANK_SQL = f"""
WITH {_SIDES},
v AS (SELECT "table" AS t, "column" AS c, CASE WHEN ltrim(value, '0') = '' THEN '0' ELSE ltrim(value, '0') END AS value FROM c),
n AS (SELECT t, c, count(*)::DOUBLE AS n, count(DISTINCT value)::DOUBLE AS d FROM v GROUP BY ALL),
p AS (SELECT x.c AS l, y.c AS r, count(DISTINCT x.value)::DOUBLE AS n_both FROM v x JOIN v y ON x.t = 0 AND y.t = 1 AND x.value = y.value GROUP BY ALL)
SELECT l AS "left", r AS "right", round(0.55::DOUBLE * n_both / least(a.d, b.d) + 0.3::DOUBLE * least(a.d / a.n, b.d / b.n) + 0.15::DOUBLE * (CASE {_ALIKE} END)::DOUBLE, 3) AS score
FROM p JOIN n a ON a.t = 0 AND a.c = l JOIN n b ON b.t = 1 AND b.c = r WHERE n_both / least(a.d, b.d) >= 0.3 AND least(a.d, b.d) > 1
"""


def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, result = pair_sides(spark, sf_dir)
    return result.counts(a, b, ["code"], ["ref"])


PAIR_SUMMARY_SQL = _PAIR_SQL + """, m AS (SELECT CAST(nation AS INT) <> CAST(country AS INT) OR abs(CAST(balance AS DECIMAL(18,2)) - CAST(replace(saldo, ',', '.') AS DECIMAL(18,2))) > 0.01 AS differs FROM a JOIN b1 USING (k))
SELECT 'rows A' AS measure, count(*) AS n FROM a UNION ALL SELECT 'rows B', count(*) FROM b UNION ALL SELECT 'only in A', count(*) FROM a WHERE k NOT IN (SELECT k FROM b)
UNION ALL SELECT 'only in B', count(*) FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT 'in both, different', count(*) FILTER (differs) FROM m UNION ALL SELECT 'in both, equal', count(*) FILTER (NOT differs) FROM m
UNION ALL SELECT 'repeated keys in A', 0 UNION ALL SELECT 'repeated keys in B', count(*) FROM (SELECT k FROM b GROUP BY k HAVING count(*) > 1)
"""


def state_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_groups(spark, sf_dir).only("only in bank").select("key", "rows_bank", "bank__amount")


STATE_VIEW_SQL = _MATRIX_SQL + "SELECT key, rows_bank, bank__amount FROM r WHERE state = 'only in bank'"


def universe_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_groups(spark, sf_dir).universe.select("key", "state")


def differences_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_groups(spark, sf_dir).ordered_differences


def sum_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("k"), F.format_string("%.2f", "l_extendedprice").alias("price"), position("l_orderkey", "l_linenumber"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.format_string("%.2f", "o_totalprice").alias("amount"), position("o_orderkey"))
    groups = [Group("lines", (GroupFile("lines", lines, ("k",)),), "sum_by_key"), Group("orders", (GroupFile("orders", orders, ("k",)),), "sum_by_key")]
    return reconcile(groups, [("price", "amount")], 0.01).matrix.select("key", "rows_lines", "lines__price", "orders__amount", "state")


SUM_BY_KEY_SQL = """
WITH l AS (SELECT l_orderkey AS k, count(*) AS n, sum(CAST(printf('%.2f', l_extendedprice) AS DECIMAL(28,6))) AS v FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, sum(CAST(printf('%.2f', o_totalprice) AS DECIMAL(28,6))) AS v FROM orders GROUP BY 1)
SELECT CAST(coalesce(l.k, o.k) AS VARCHAR) AS key, coalesce(n, 0)::BIGINT AS rows_lines, CAST(l.v AS DOUBLE) AS lines__price, CAST(o.v AS DOUBLE) AS orders__amount,
       CASE WHEN l.k IS NULL THEN 'only in orders' WHEN o.k IS NULL THEN 'only in lines' ELSE 'in all' END AS state FROM l FULL JOIN o ON l.k = o.k
"""


def part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(table(spark, sf_dir, "part"), "p_type")


PART_TYPES_SQL = "SELECT DISTINCT trim(p_type) AS value FROM part WHERE trim(p_type) <> '' ORDER BY 1 LIMIT 501"

_RULES = {
    "negation": (Rule("N", "not (cust < 100) and -cust < -50", "record", "02"), "SELECT line FROM o WHERE cust < 100"),
    "membership": (Rule("M", 'segment in ["BUILDING", "MACHINERY", "FURNITURE"] and segment not in ["FURNITURE"]', "record", "03"), "SELECT line FROM c WHERE segment NOT IN ('BUILDING', 'MACHINERY')"),
    "numbers": (Rule("F", "abs(cust - 500) >= 100 and redondear(cust / 4, 0) > 10 and longitud(kind) == 2", "record", "02"), "SELECT line FROM o WHERE abs(cust - 500) < 100 OR round(cust / 4) <= 10"),
}


def _rule(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return violations(_RULES[name][0], LAYOUT, parsed(spark, sf_dir).frames, spark).select(F.col("_line").alias("line"))

    return run


def delimited_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of a delimited layout, rendered."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_line"), F.col("o_orderkey").cast("string").alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.format_string("%.2f", "o_totalprice").alias("price"), "o_orderstatus")
    record = DELIMITED.records[0]
    frames = {record.code: records_from(o, record, {"id": "number", "day": "day", "price": "price", "status": "o_orderstatus"})}
    return render_lines(frames, DELIMITED).select("line", "value")


DELIMITED_WRITE_SQL = """
SELECT o_orderkey AS line, o_orderkey || ';' || strftime(o_orderdate, '%d/%m/%Y') || ';' || printf('%.2f', o_totalprice) || ';' || o_orderstatus AS value FROM orders
"""


def case_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right states of one synthetic case a locale, with the complete configuration; sized by the customers."""
    n = table(spark, sf_dir, "customer").count()
    found = None
    for seed, locale in enumerate(cases.LOCALES):
        case = cases.make_case(spark, n, seed, locale)
        one = cases.accuracy(case, cases.run_case(case)).select(F.lit(locale).alias("locale"), "right", "total")
        found = one if found is None else found.unionByName(one)
    return found


CASE_SQL = "SELECT unnest(['es', 'en', 'pt']) AS locale, count(*) AS right, count(*) AS total FROM customer"

QUERIES = {
    "q_key_strength": (key_strengths, KEY_STRENGTH_SQL),
    "q_pair_ranking": (pair_ranks, PAIR_RANK_SQL),
    "q_pair_summary": (pair_summary, PAIR_SUMMARY_SQL),
    "q_state_view": (state_view, STATE_VIEW_SQL),
    "q_universe_order": (universe_order, _MATRIX_SQL + "SELECT key, state FROM r ORDER BY key"),
    "q_differences_order": (differences_order, _MATRIX_SQL + "SELECT key, differences FROM r WHERE differences <> '' ORDER BY key"),
    "q_sum_by_key": (sum_by_key, SUM_BY_KEY_SQL),
    "q_distinct_values": (part_types, PART_TYPES_SQL),
    **{f"q_rule_{name}": (_rule(name), f"WITH {_O} {sql}") for name, (_, sql) in _RULES.items()},
    "q_delimited_write": (delimited_write, DELIMITED_WRITE_SQL),
    "q_case_accuracy": (case_accuracy, CASE_SQL),
}
