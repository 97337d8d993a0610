"""Key profiles, usage metrics, retrieval and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.operators.filters import Filter
from cotejo.operators.keys import key_ranking, overlap_frame, profile_frame
from cotejo.operators.keys import frequent_values as frequent
from cotejo.operators.reconcile import Group, GroupFile, reconcile
from cotejo.operators.retrieval import lexical_scores, split_documents
from cotejo.operators.usage import by_origin, confidence, confusion, event_table, memory_mode, memory_table, summary, use_sequence
from cotejo.plans.fixtures import bank, ledger, table
from cotejo.plans.reconcile_queries import two_groups


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [ledger(spark, sf_dir).drop("_pos"), bank(spark, sf_dir).drop("_pos")]


def key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile_frame(_tables(spark, sf_dir), None)
    return p.select("table", "column", "n", "distinct", "digits", F.bround("dates", 6).alias("dates"), F.bround("amounts", 6).alias("amounts"))


_SIDES = """
o AS (SELECT o_orderkey AS k, o_orderkey % 20 AS r, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders),
l AS (SELECT CAST(k AS VARCHAR) AS key, CAST(a AS VARCHAR) AS amount FROM o WHERE r < 18),
b AS (SELECT substr(lpad(CAST(k AS VARCHAR), 12, '0'), 1, 4) || '-' || substr(lpad(CAST(k AS VARCHAR), 12, '0'), 5) AS ref, CAST(CAST(CASE WHEN r = 11 THEN a + 0.01 WHEN r = 12 THEN a - 0.01 WHEN r IN (13, 14, 15) THEN CAST(round(a * 0.5, 2) AS DECIMAL(18,2)) ELSE a END AS DECIMAL(18,2)) AS VARCHAR) AS amount,
             CASE WHEN r = 17 THEN 'VOID' ELSE 'OK' END AS status FROM o WHERE r <> 16
      UNION ALL SELECT substr(lpad(CAST(k AS VARCHAR), 12, '0'), 1, 4) || '-' || substr(lpad(CAST(k AS VARCHAR), 12, '0'), 5), CAST(CAST(a - CAST(round(a * 0.5, 2) AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS VARCHAR), 'OK' FROM o WHERE r = 15),
c AS (SELECT 0 AS "table", 'key' AS "column", key AS value FROM l UNION ALL SELECT 0, 'amount', amount FROM l UNION ALL SELECT 1, 'ref', ref FROM b UNION ALL SELECT 1, 'amount', amount FROM b UNION ALL SELECT 1, 'status', status FROM b)
"""
KEY_PROFILE_SQL = f"""
WITH {_SIDES}
SELECT "table", "column", count(*) AS n, count(DISTINCT value) AS distinct, median(length(ltrim(regexp_replace(value, '[^0-9]', '', 'g'), '0'))) AS digits,
       round_even(avg(CASE WHEN regexp_matches(value, '^[0-9]{{1,4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,4}}') THEN 1.0 ELSE 0 END), 6) AS dates,
       round_even(avg(CASE WHEN regexp_matches(value, '^-?[0-9]+[.,][0-9]{{1,3}}$') THEN 1.0 ELSE 0 END), 6) AS amounts FROM c GROUP BY ALL
"""


def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_frame(_tables(spark, sf_dir), [["key", "amount"], ["ref", "amount", "status"]])


KEY_OVERLAP_SQL = f"""
WITH {_SIDES},
f AS (SELECT DISTINCT 'exact' AS form, "table", "column", value FROM c UNION
      SELECT DISTINCT 'digits', "table", "column", CASE WHEN ltrim(regexp_replace(value, '[^0-9]', '', 'g'), '0') = '' THEN '0' ELSE ltrim(regexp_replace(value, '[^0-9]', '', 'g'), '0') END FROM c WHERE regexp_matches(value, '[0-9]')),
s AS (SELECT form, "table", "column", count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT x.form, x."table" AS left_table, x."column" AS left_column, y."table" AS right_table, y."column" AS right_column, count(*) AS n_both FROM f x JOIN f y ON x.form = y.form AND x.value = y.value AND x."table" < y."table" GROUP BY ALL)
SELECT p.*, a.n AS n_left, b.n AS n_right FROM p JOIN s a ON a.form = p.form AND a."table" = left_table AND a."column" = left_column JOIN s b ON b.form = p.form AND b."table" = right_table AND b."column" = right_column
"""


def key_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_ranking(_tables(spark, sf_dir)).withColumn("strength", F.round("strength", 6))


#: "key" and "ref" are the columns that sound like keys and hold no amounts; both forms are weighed.
KEY_SUGGESTION_SQL = f"""
WITH {_SIDES},
u AS (SELECT "table", "column", least(1.0::DOUBLE, count(DISTINCT value) / count(*) / 0.5::DOUBLE) AS factor FROM c GROUP BY ALL),
f AS (SELECT DISTINCT 'exact' AS form, "table", "column", value FROM c UNION
      SELECT DISTINCT 'digits', "table", "column", CASE WHEN ltrim(regexp_replace(value, '[^0-9]', '', 'g'), '0') = '' THEN '0' ELSE ltrim(regexp_replace(value, '[^0-9]', '', 'g'), '0') END FROM c WHERE regexp_matches(value, '[0-9]')),
s AS (SELECT form, "table", "column", count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT x.form, count(*) AS n_both FROM f x JOIN f y ON x.form = y.form AND x.value = y.value AND x."column" = 'key' AND y."column" = 'ref' GROUP BY ALL),
k AS (SELECT p.form, n_both::DOUBLE / least(a.n, b.n) * least(ua.factor, ub.factor) AS strength, ua.factor FROM p JOIN s a ON a.form = p.form AND a."column" = 'key' JOIN s b ON b.form = p.form AND b."column" = 'ref'
      JOIN u ua ON ua."column" = 'key' JOIN u ub ON ub."column" = 'ref'),
w AS (SELECT * FROM k ORDER BY strength - CASE form WHEN 'exact' THEN 0 ELSE 0.001 END DESC LIMIT 1)
SELECT 0 AS "table", 'key' AS "column", form, round(factor::DOUBLE, 6) AS strength FROM w UNION ALL SELECT 1, 'ref', form, round(strength::DOUBLE, 6) FROM w
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    origin = "element_at(array('heuristica', 'memoria', 'memoria_auto', 'guardado', 'ia'), cast(event_id % 5 + 1 AS int))"
    return event_table(e.select(
        F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("usuario_id"), F.concat(F.lit("s"), (F.col("user_id") % 37).cast("string")).alias("firma_archivos"), F.expr(origin).alias("origen"),
        F.expr("event_id % 3 = 0").alias("corregida"), F.expr("round(value, 3)").alias("segundos_preparacion"), F.expr("round(value * 0.5, 3)").alias("segundos_cruce"),
        F.expr("if(event_id % 5 = 4, event_id % 3, 0)").alias("llamadas_ia"), F.expr("event_id % 1000").alias("tokens_ia"), F.expr("event_id % 2 = 0").alias("ia_llave_validada"), "event_id",
    ))


_EVENTS = """
WITH e AS (SELECT event_id, ts, user_id, 's' || (user_id % 37) AS sig, (['heuristica', 'memoria', 'memoria_auto', 'guardado', 'ia'])[event_id % 5 + 1] AS origin, event_id % 3 = 0 AS wrong,
  round(value, 3) AS prep, round(value * 0.5, 3) AS run, CASE WHEN event_id % 5 = 4 THEN event_id % 3 ELSE 0 END AS calls, event_id % 1000 AS tokens, event_id % 2 = 0 AS valid FROM events)
"""


def usage_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_sequence(_events(spark, sf_dir), order=("created_at", "event_id")).select("event_id", F.col("firma_archivos").alias("signature"), "use")


USAGE_SEQUENCE_SQL = _EVENTS + "SELECT event_id, sig AS signature, row_number() OVER (PARTITION BY sig ORDER BY ts, event_id) AS use FROM e"


def usage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(_events(spark, sf_dir))


USAGE_METRICS_SQL = _EVENTS + """, m AS (SELECT count(*) AS runs, count(DISTINCT user_id) AS users, count(DISTINCT sig) AS signatures, count(*) FILTER (origin LIKE 'memoria%') AS learned,
  count(*) FILTER (origin LIKE 'memoria%' AND NOT wrong) AS accepted, count(*) FILTER (origin LIKE 'memoria%' AND wrong) AS corrected, count(*) FILTER (origin = 'memoria_auto') AS automatic,
  median(prep) FILTER (origin = 'heuristica') AS h, median(prep) FILTER (origin IN ('memoria', 'memoria_auto', 'guardado')) AS r, count(*) FILTER (calls > 0) AS asked_ai, count(*) FILTER (calls > 0 AND valid) AS ai_valid,
  CAST(sum(calls) AS BIGINT) AS ai_calls, CAST(sum(tokens) AS BIGINT) AS ai_tokens, round_even(median(run), 2) AS median_run FROM e)
SELECT * EXCLUDE (h, r), round_even(100.0::DOUBLE * accepted / learned, 1) AS acceptance, round_even(100.0::DOUBLE * (h - r) / h, 1) AS saving, round_even(h, 1) AS median_by_hand, round_even(r, 1) AS median_reused FROM m
"""


def usage_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_origin(_events(spark, sf_dir))


USAGE_ORIGIN_SQL = _EVENTS + "SELECT origin, count(*) AS runs, round_even(median(prep), 1) AS median_preparation, count(*) FILTER (wrong) AS corrected, CAST(sum(tokens) AS DOUBLE) AS tokens FROM e GROUP BY origin"


def usage_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memory_table(_events(spark, sf_dir).withColumn("corregida", F.expr("event_id % 3 = 0 AND firma_archivos > 's2'")))
    return m.withColumn("mode", memory_mode(F.col("used") > 0, F.col("confidence"), F.col("signature") > "s15"))


CONFIDENCE_SQL = _EVENTS + """, m AS (SELECT sig AS signature, count(*) AS used, count(*) FILTER (wrong AND sig > 's2') AS corrected FROM e GROUP BY sig),
c AS (SELECT *, CAST(greatest(0, least(100, round_even(100.0::DOUBLE * (used - corrected + 1) / (used + 2), 0))) AS INTEGER) AS confidence FROM m)
SELECT *, CASE WHEN confidence > 95 AND signature > 's15' THEN 'automatic' WHEN confidence > 95 THEN 'offer_auto' ELSE 'offer' END AS mode FROM c
"""


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.expr("CASE WHEN o_orderkey % 20 IN (13, 14) THEN 'different' WHEN o_orderkey % 20 IN (16, 17) THEN 'only ledger' WHEN o_orderkey % 20 > 17 THEN 'only bank' ELSE 'equal' END").alias("state"))
    m = two_groups(spark, sf_dir).matrix
    found = m.select("key", F.expr("CASE WHEN has_diff THEN 'different' WHEN in_all THEN 'equal' WHEN in_ledger THEN 'only ledger' ELSE 'only bank' END").alias("state"))
    return confusion(truth, found, "key", ["equal", "different", "only ledger", "only bank"])


CONFUSION_SQL = """
SELECT CASE WHEN o_orderkey % 20 IN (13, 14) THEN 'different' WHEN o_orderkey % 20 IN (16, 17) THEN 'only ledger' WHEN o_orderkey % 20 > 17 THEN 'only bank' ELSE 'equal' END AS class, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, count(*) AS n FROM orders GROUP BY 1
"""


def ablation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of keys whose state is right: complete, without tolerance, without the exclusion of voids."""
    truth = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.expr("CASE WHEN o_orderkey % 20 IN (13, 14) THEN 'different' WHEN o_orderkey % 20 IN (16, 17) THEN 'only ledger' WHEN o_orderkey % 20 > 17 THEN 'only bank' ELSE 'equal' END").alias("truth"))
    void = (Filter("status", "==", ("VOID",), as_numbers=False),)
    out = None
    for name, tolerance, filters in (("complete", 0.01, void), ("no tolerance", 0.0, void), ("no exclusion", 0.01, ())):
        groups = [Group("ledger", (GroupFile("ledger", ledger(spark, sf_dir), ("key",), "digits"),)), Group("bank", (GroupFile("bank", bank(spark, sf_dir), ("ref",), "digits", filters),))]
        m = reconcile(groups, [("amount", "amount")], tolerance).matrix
        found = m.select("key", F.expr("CASE WHEN has_diff THEN 'different' WHEN in_all THEN 'equal' WHEN in_ledger THEN 'only ledger' ELSE 'only bank' END").alias("found"))
        right = truth.join(found, "key", "full_outer").agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("truth") == F.col("found")).alias("n_right"))
        row = right.select(F.lit(name).alias("variant"), "n_keys", "n_right", F.bround(100.0 * F.col("n_right") / F.col("n_keys"), 1).alias("accuracy"))
        out = row if out is None else out.unionByName(row)
    return out


ABLATION_SQL = """
WITH o AS (SELECT o_orderkey % 20 AS r FROM orders),
v AS (SELECT 'complete' AS variant, count(*) AS n_keys, count(*) AS n_right FROM o UNION ALL SELECT 'no tolerance', count(*), count(*) FILTER (r NOT IN (11, 12)) FROM o UNION ALL SELECT 'no exclusion', count(*), count(*) FILTER (r <> 17) FROM o)
SELECT *, round_even(100.0::DOUBLE * n_right / n_keys, 1) AS accuracy FROM v
"""


def pivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("band", F.col("user_id") % 10)
    wide = e.groupBy("band").pivot("event_type", ["click", "view", "purchase"]).agg(F.avg(F.round("value", 2).cast("decimal(18,2)")))
    return wide.select("band", *[F.bround(F.col(c).cast("double"), 4).alias(c) for c in ("click", "view", "purchase")])


PIVOT_SQL = "SELECT user_id % 10 AS band, " + ", ".join(f"round_even(CAST(sum(CAST(round(value, 2) AS DECIMAL(18,2))) FILTER (event_type = '{t}') AS DOUBLE) / nullif(count(*) FILTER (event_type = '{t}'), 0), 4) AS {t}" for t in ("click", "view", "purchase")) + " FROM events GROUP BY 1"


def evaluation_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("value"), 6).alias("mean"), F.bround(F.stddev_samp("value"), 6).alias("deviation"))


MEANS_SQL = "SELECT event_type, count(*) AS n, round_even(avg(value), 6) AS mean, round_even(stddev_samp(value), 6) AS deviation FROM events GROUP BY event_type"


def frequent_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent(table(spark, sf_dir, "part"), "p_type")


FREQUENT_SQL = "SELECT trim(p_type) AS value, count(*) AS n_rows FROM part GROUP BY 1 ORDER BY n_rows DESC, value LIMIT 5"


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lexical_scores(table(spark, sf_dir, "documents"), ["doc_id"], "text", ["ation", "idiot", "the", "license", "email"])
    return scored.select("doc_id", F.bround("score", 6).alias("score"))


_ASKED = ("ation", "idiot", "the", "license", "email")
LEXICAL_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
c AS (SELECT doc_id, {', '.join(f"len(list_filter(w, lambda x: x = '{t}')) AS n{i}" for i, t in enumerate(_ASKED))} FROM w),
d AS (SELECT count(*)::DOUBLE AS n, {', '.join(f'count(*) FILTER (n{i} > 0) AS d{i}' for i in range(len(_ASKED)))} FROM c),
s AS (SELECT doc_id, {' + '.join(f'CASE WHEN n{i} > 0 THEN ln(1 + n / (1 + d{i})) * n{i} / (n{i} + 1.5::DOUBLE) ELSE 0 END' for i in range(len(_ASKED)))} AS score FROM c, d)
SELECT doc_id, round_even(score, 6) AS score FROM s WHERE score > 0
"""

QUERIES = {
    "q_key_profile": (key_profile, KEY_PROFILE_SQL),
    "q_key_overlap": (key_overlap, KEY_OVERLAP_SQL),
    "q_key_suggestion": (key_suggestion, KEY_SUGGESTION_SQL),
    "q_usage_sequence": (usage_sequence, USAGE_SEQUENCE_SQL),
    "q_usage_metrics": (usage_metrics, USAGE_METRICS_SQL),
    "q_usage_by_origin": (usage_by_origin, USAGE_ORIGIN_SQL),
    "q_confidence": (usage_confidence, CONFIDENCE_SQL),
    "q_confusion_metrics": (confusion_metrics, CONFUSION_SQL),
    "q_ablation_accuracy": (ablation_accuracy, ABLATION_SQL),
    "q_pivot_mean": (pivot_mean, PIVOT_SQL),
    "q_evaluation_means": (evaluation_means, MEANS_SQL),
    "q_frequent_values": (frequent_segments, FREQUENT_SQL),
    "q_chunk_documents": (chunk_documents, None),
    "q_lexical_score": (lexical_score, LEXICAL_SQL),
}
