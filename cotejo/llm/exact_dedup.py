"""Exact deduplication by content-defined chunk recipes.

1. A text, white space collapsed, is cut where a rolling hash of its last 8 bytes meets a mask, so equal passages give
   equal chunks wherever they stand. A document becomes a recipe: the ordered digests of its chunks.
2. Chunks are deduplicated by (digest, content), first within a batch, then within a task, then over the shuffle. A digest
   with one content is a verified identifier. A digest with several contents is not: the recipes of documents that hold it
   are formed again with the content itself in its place.
3. Documents with equal ordered identifier lists are equal. Only these lists, 16 bytes a chunk of about 1 KB, are compared.

Defined results: null text counts as empty and all empty texts are equal; of equal texts the smallest doc_id stays, a null
doc_id counts as largest, and of rows that repeat one doc_id the first in the input stays; an empty table gives an empty
result; very long texts are cut in slices; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import SPACE_CLASS, arrow_batches, fresh, give_back, lean, numbered, read_table, small_side, stage_table, text_of

#: Cut where the top CUT_BITS bits of the window's hash are 0: chunks of 2 ** CUT_BITS bytes on average, MIN to MAX long.
CUT_BITS, MIN_CHUNK, MAX_CHUNK = 10, 256, 8192
#: Unverified digests that are sent to all tasks; if there are more, every identifier carries its content.
MAX_UNVERIFIED = 1000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


_SLICE = 1 << 20


def _marks(raw: np.ndarray) -> np.ndarray:
    """Ends of the 8-byte windows whose hash meets the mask, never inside a character."""
    found = []
    for start in range(0, max(0, len(raw) - 7), _SLICE):
        part = raw[start : start + _SLICE + 7]
        windows = np.lib.stride_tricks.as_strided(part, (len(part) - 7, 8), (1, 1)).copy().view("<u8").ravel()
        found.append(np.flatnonzero((windows * _MULTIPLIER) >> np.uint64(64 - CUT_BITS) == 0) + (start + 8))
    marks = np.concatenate(found) if found else np.empty(0, np.int64)
    return marks[(marks < len(raw)) & ((raw[np.minimum(marks, len(raw) - 1)] & 0xC0) != 0x80)] if len(marks) else marks


def cut_points(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of data; the last is len(data)."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    ends, start = [], 0
    for mark in [*_marks(np.frombuffer(data, np.uint8)).tolist(), n]:
        while mark - start > MAX_CHUNK:
            end = start + MAX_CHUNK
            while data[end] & 0xC0 == 0x80:
                end -= 1
            ends.append(end)
            start = end
        if mark == n or mark - start >= MIN_CHUNK:
            ends.append(mark)
            start = mark
    return ends


def _chunks(text: str, digest_size: int) -> Iterator[tuple[bytes, bytes]]:
    data, start = text.encode(), 0
    for end in cut_points(data):
        chunk = data[start:end]
        yield hashlib.blake2b(chunk, digest_size=digest_size).digest(), chunk
        start = end


def _recipes(digest_size: int, unverified: frozenset[bytes] | None):
    """Batches of (_at, _doc, _norm, _sha) become (_at, _doc, _sha, _recipe). unverified: None for all digests."""

    def identifier(digest: bytes, chunk: bytes) -> bytes:
        return digest + len(chunk).to_bytes(4, "big") + chunk if unverified is None or digest in unverified else digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipes = [b"".join(identifier(*c) for c in _chunks(t, digest_size)) for t in batch.column("_norm").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_at"), batch.column("_doc"), batch.column("_sha"), pa.array(recipes, pa.binary())], ["_at", "_doc", "_sha", "_recipe"])

    return lean(run)


def _contents(digest_size: int):
    """Batches of (_norm) become the distinct (_digest, _chunk) of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {c for t in batch.column("_norm").to_pylist() for c in _chunks(t, digest_size)}
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([c for _, c in found], pa.binary())], ["_digest", "_chunk"])

    return lean(run)


def _classes(rows: DataFrame, at: str, id_col: str, text_col: str, digest_size: int) -> DataFrame:
    """One row per row of rows, whose numbers are in column `at`."""
    arrow_batches(rows.sparkSession, 1000)
    norm = F.regexp_replace(text_of(text_col), SPACE_CLASS, " ")
    texts = rows.select(F.col(at).alias("_at"), F.col(id_col).cast("long").alias("_doc"), norm.alias("_norm"))
    texts = texts.withColumn("_sha", F.sha2(F.col("_norm").cast("binary"), 256))
    contents = rows.select(norm.alias("_norm")).mapInArrow(_contents(digest_size), "_digest binary, _chunk binary")
    clashing = contents.distinct().groupBy("_digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    unverified = frozenset(bytes(r[0]) for r in clashing.select("_digest").limit(MAX_UNVERIFIED + 1).collect())
    give_back()
    listed = stage_table(texts.mapInArrow(_recipes(digest_size, unverified if len(unverified) <= MAX_UNVERIFIED else None), "_at long, _doc long, _sha string, _recipe binary"), "recipes")
    first = F.min(F.struct(F.col("_doc").isNull().alias("_none"), "_doc", "_at")).alias("_first")
    several = stage_table(listed.groupBy("_recipe").agg(first, F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "equal-recipes")
    return listed.join(several, "_recipe", "left")


def classes_of_equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_size: int = 16) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Two passes over the texts: one writes the recipes, one verifies the identifiers. At 16 bytes a digest the unverified
    ones are expected to be none. Few are sent to the tasks; if there were many, all recipes would hold their contents.
    """
    at = fresh(docs, "_at")
    out = _classes(numbered(docs, at), at, id_col, text_col, digest_size)
    return out.select(
        F.col("_doc").alias(id_col),
        F.when(F.col("_first").isNull(), F.col("_doc")).otherwise(F.col("_first._doc")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_first").isNull() | (F.col("_first._at") == F.col("_at"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text an earlier-numbered row has."""
    at = fresh(docs, "_at")
    rows = numbered(docs, at)
    gone = _classes(rows, at, id_col, text_col, 16).filter("_first._at <> _at").select(F.col("_at").alias(at))
    return rows.join(small_side(stage_table(gone, "gone")), at, "left_anti").select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of_equal_texts(read_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
