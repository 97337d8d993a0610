"""Proportional stratified interleaving into shards, DataFrame operations only.

Within each source, rows take a seeded random order; a row's fractional rank is (rank + 1/2) / rows of its source. The
whole table is ordered by fractional rank, so every stretch of it holds the sources in their global proportions, and is
cut into shards of equal row counts (at most one apart).

Defined results: a null source is a stratum of its own; null or empty text counts 0 bytes; rows with equal fractional
rank are ordered by source, then by hash, doc_id and position in the input; repeated rows are placed one by one; an empty
table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import hash_slice, read_table, seeded_hash, shuffle_width, stage_table, text_of, with_ranks

SEED = 17
SHARDS = 40


def stratified_interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Columns: id_col, carry, shard (int), slot (long, 0, 1, ... within the shard).

    Only identifiers and `carry` columns move. Two window passes over pieces of a few hundred rows each replace the two
    global sorts: pieces of a source are slices of the hash, pieces of the table are slices of the fractional rank.
    """
    spark = docs.sparkSession
    slices = 4 * shuffle_width(spark)
    keep = [id_col, *(carry or [])]
    slim = docs.select(
        *keep,
        F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source_col).cast("string"))).alias("_stratum"),
        seeded_hash(seed, F.col(id_col)).alias("_hash"),
        F.monotonically_increasing_id().alias("_at"),
    )
    slim = stage_table(slim, "interleave-rows")
    ranked = with_ranks(slim, ["_stratum"], hash_slice(F.col("_hash"), slices), ["_hash", id_col, "_at"], "_rank", "_of")
    ranked = ranked.withColumn("_fraction", (F.col("_rank") + F.lit(0.5)) / F.col("_of"))
    ranked = stage_table(ranked, "interleave-ranks")
    placed = with_ranks(ranked, [], F.floor(F.col("_fraction") * slices).cast("int"), ["_fraction", "_stratum", "_hash", id_col, "_at"], "_place", "_all")
    shard = F.expr(f"_place * {shards} div _all")
    return placed.select(
        *keep,
        shard.cast("int").alias("shard"),
        (F.col("_place") - F.expr(f"((_place * {shards} div _all) * _all + {shards - 1}) div {shards}")).alias("slot"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: shard counts differ by one at most."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text_of()).cast("bigint") + 16).alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    )
    out = stratified_interleave(docs, carry=["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 with polynomial 0xEDB88320 is spelled out, since DuckDB has none.
OP7_SQL = f"""
WITH RECURSIVE poly(i, k, x) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END FROM poly WHERE k < 8),
tab AS (SELECT list(x ORDER BY i) AS t FROM poly WHERE k = 8),
hexes AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS hx FROM documents),
crc AS (
  SELECT doc_id, source, length(hx) // 2 AS n_bytes,
         xor(4294967295, list_reduce(list_transform(range(1, length(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::BIGINT),
             lambda a, y: xor(a // 256, t[(xor(a, y) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM hexes, tab),
hashed AS (
  SELECT *, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS stratum,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM crc),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id) - 1 + 0.5::DOUBLE)
            / count(*) OVER (PARTITION BY stratum) AS fraction FROM hashed),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, h, doc_id) - 1 AS place, count(*) OVER () AS n FROM ranked)
SELECT doc_id, (n_bytes + 16)::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law,
       (place * {SHARDS} // n)::INTEGER AS shard,
       (place - ((place * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""
