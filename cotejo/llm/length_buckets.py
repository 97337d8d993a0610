"""Packing into optimal length buckets: dynamic programming over the global histogram, token-budget batches per bucket.

Every document is a sequence of word tokens; one longer than MAX_TOKENS is split, losslessly, into parts of MAX_TOKENS and a
rest. The histogram of part lengths, at most MAX_TOKENS bins whatever the input, is the only thing the driver gathers. The
dynamic programme picks the bucket boundaries with the least padding among all choices of BUCKETS boundaries. Inside a bucket,
parts take a seeded random order and are cut into batches of as many rows as the token budget allows at the boundary length.

Defined results: null or empty text is one part of 0 tokens in the first bucket; equal cost of two boundary sets is settled
for the shorter boundaries; repeated rows are packed one by one; an empty table gives an empty result; columns other than the
named ones are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import SPACE_CLASS, hash_slice, read_table, seeded_hash, shuffle_width, stage_table, text_of, with_ranks

MAX_TOKENS, BUCKETS, BATCH_TOKENS, SEED = 2048, 16, 65536, 29


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Ascending boundaries, at most `buckets`, the last at the greatest length, that minimise the padded total.

    cost[k][j] = min over i < j of cost[k - 1][i] + rows(i, j] * length[j]; exact in integers.
    """
    if not lengths:
        return []
    order = np.argsort(lengths)
    at = np.asarray(lengths, np.int64)[order]
    upto = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64)[order])])
    n = len(at)
    far = np.int64(2**62)
    best = np.full(n + 1, far)
    best[0] = 0
    taken = []
    for _ in range(min(buckets, n)):
        new, origin = np.full(n + 1, far), np.zeros(n + 1, np.int64)
        new[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + np.where(best[:j] < far, (upto[j] - upto[:j]) * at[j - 1], 0)
            origin[j] = int(np.argmin(cost))
            new[j] = cost[origin[j]]
        taken.append(origin)
        best = new
    found, j = [], n
    for origin in reversed(taken):
        if j == 0:
            break
        found.append(int(at[j - 1]))
        j = int(origin[j])
    return found[::-1]


def pack_by_length(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, seed: int = SEED
) -> DataFrame:
    """One row per part: id_col, part, start (token), n_tokens, bucket_tokens, batch (long, gapless), slot, padding."""
    spark = docs.sparkSession
    counted = docs.select(
        F.col(id_col),
        F.monotonically_increasing_id().alias("_at"),
        F.size(F.array_remove(F.split(text_of(text_col), SPACE_CLASS), "")).alias("_words"),
    )
    parts = counted.withColumn("part", F.explode(F.expr(f"sequence(0, greatest(0, (_words - 1) div {max_tokens}))"))).select(
        id_col,
        "_at",
        F.col("part").cast("int").alias("part"),
        (F.col("part") * max_tokens).cast("long").alias("start"),
        F.least(F.lit(max_tokens), F.col("_words") - F.col("part") * max_tokens).cast("int").alias("n_tokens"),
        seeded_hash(seed, F.col(id_col), F.col("part")).alias("_hash"),
    )
    parts = stage_table(parts, "parts")
    histogram: dict[int, int] = {}
    for n, rows in parts.groupBy("n_tokens").count().collect():
        histogram[max(1, n)] = histogram.get(max(1, n), 0) + rows
    bounds = optimal_boundaries(list(histogram), list(histogram.values()), buckets) or [1]
    bucket, first, offset = F.lit(None), {}, 0
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bucket)
    for b, low in zip(bounds, [0, *bounds]):
        first[b] = offset
        rows_in = sum(c for n, c in histogram.items() if low < n <= b)
        offset += -(-rows_in // max(1, batch_tokens // b))
    offsets = F.create_map(*[F.lit(x) for b, o in first.items() for x in (b, o)])
    placed = with_ranks(
        parts.withColumn("bucket_tokens", bucket.cast("int")), ["bucket_tokens"], hash_slice(F.col("_hash"), 4 * shuffle_width(spark)), ["_hash", id_col, "_at", "part"], "_rank", "_of"
    )
    fit = F.expr(f"greatest(1, {batch_tokens} div bucket_tokens)")
    return placed.withColumn("_fit", fit).select(
        id_col,
        "part",
        "start",
        "n_tokens",
        "bucket_tokens",
        (offsets[F.col("bucket_tokens")] + F.expr("_rank div _fit")).cast("long").alias("batch"),
        (F.col("_rank") % F.col("_fit")).cast("int").alias("slot"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_length(read_table(spark, sf_dir, "documents"))


#: The dynamic programme in SQL: a step of the recursion adds a boundary; `froms` keeps where each best choice came from.
OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM documents),
parts AS (
  SELECT doc_id, p AS part, p * {MAX_TOKENS} AS start, least({MAX_TOKENS}, n - p * {MAX_TOKENS}) AS n_tokens
  FROM (SELECT doc_id, n, unnest(range(0, greatest(0, (n - 1) // {MAX_TOKENS}) + 1)) AS p FROM w)),
h AS (SELECT greatest(1, n_tokens) AS l, count(*) AS c FROM parts GROUP BY 1),
lists AS (SELECT list(l ORDER BY l) AS ls, list(c ORDER BY l) AS cs, count(*)::INT AS n FROM h),
pre AS (SELECT ls, n, list_prepend(0, list_transform(range(1, n + 1), lambda j: list_sum(cs[1:j])))::BIGINT[] AS upto FROM lists),
dp AS (
  SELECT 0 AS k, list_prepend(0, list_transform(range(n), lambda j: 1000000000000000))::BIGINT[] AS best, []::BIGINT[][] AS froms FROM pre
  UNION ALL
  SELECT k + 1, list_prepend(0, list_transform(m, lambda x: list_min(x)))::BIGINT[],
         list_append(froms, list_prepend(0, list_transform(m, lambda x: list_position(x, list_min(x)) - 1))::BIGINT[])
  FROM (SELECT k, best, froms, n, list_transform(range(1, n + 1), lambda j: list_transform(range(0, j),
          lambda i: CASE WHEN best[i + 1] < 1000000000000000 THEN best[i + 1] + (upto[j + 1] - upto[i + 1]) * ls[j] ELSE 1000000000000000 END)) AS m
        FROM dp, pre WHERE k < least({BUCKETS}, n))),
last AS (SELECT * FROM dp ORDER BY k DESC LIMIT 1),
back AS (
  SELECT k, n AS j, NULL::BIGINT AS b FROM last, pre
  UNION ALL
  SELECT back.k - 1, froms[back.k][j + 1]::INT, ls[j] FROM back, last, pre WHERE back.k > 0 AND j > 0),
bounds AS (SELECT b, lag(b, 1, 0) OVER (ORDER BY b) AS low FROM back WHERE b IS NOT NULL),
put AS (
  SELECT p.*, b, greatest(1, {BATCH_TOKENS} // b) AS fit,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || part), 1, 15))::BIGINT AS hash
  FROM parts p JOIN bounds ON greatest(1, n_tokens) > low AND greatest(1, n_tokens) <= b),
firsts AS (SELECT b, sum(batches) OVER (ORDER BY b) - batches AS first FROM (SELECT b, (count(*) + any_value(fit) - 1) // any_value(fit) AS batches FROM put GROUP BY b)),
ranked AS (SELECT put.*, first, row_number() OVER (PARTITION BY put.b ORDER BY hash, doc_id, part) - 1 AS r FROM put JOIN firsts USING (b))
SELECT doc_id, part::INT AS part, start::BIGINT AS start, n_tokens::INT AS n_tokens, b::INT AS bucket_tokens, (first + r // fit)::BIGINT AS batch, (r % fit)::INT AS slot,
       (b - n_tokens)::INT AS padding FROM ranked
"""
