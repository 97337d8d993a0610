"""Best-fit-decreasing packing of token ids into fixed rows, with a segment tree over free capacities.

Documents are encoded by a byte-level vocabulary, whose ids give any text back, split losslessly into segments of at most
`context` ids, and dealt by a hash of their position to groups of bounded rows and bytes; each group is packed by itself, so
nothing grows with the input but the number of groups, which depends on the documents alone. A group leaves at most one row
less than half full for its shortest segments, of some hundred rows. Inside a group, segments come longest first (ties: doc_id, part) and go to the row with the least free space that
holds them, found in a segment tree whose leaves are free capacities. A row keeps its segments' ids one after another, the
cumulative segment lengths, and positions that start again at 0 with each segment.

Defined results: null text, and text without tokens, has one empty segment, kept in the row lists with length 0; repeated rows
are packed one by one; an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import arrow_batches, read_table, text_of

CONTEXT, GROUP_ROWS, GROUP_BYTES = 2048, 4096, 4 << 20


class CapacityTree:
    """How many rows have each free capacity 0 to `size`; finds the least capacity of at least n that some row has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]
        self.count = [0] * (2 * self.leaves)

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) of the tightest fit, taken out."""
        node = least + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.count[2 * node])
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], context: int) -> list[list[int]]:
    """Rows of indexes into lengths; lengths are at most context and already in the order of packing."""
    tree, rows = CapacityTree(context), []
    for i, n in enumerate(lengths):
        fit = tree.take(n)
        if fit is None:
            rows.append([i])
            tree.put(context - n, len(rows) - 1)
        else:
            rows[fit[1]].append(i)
            tree.put(fit[0] - n, fit[1])
    return rows


_PACKED = "group int, row int, n_tokens int, doc_ids array<long>, parts array<int>, cu_seqlens array<int>, ids binary, positions binary"


#: Fixed value: the word pattern of the public byte-level vocabulary.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, object] = {}


def byte_encoder(file_text: str, pattern: str = WORDS):
    """tiktoken's encoder for a file of "base64 rank" lines; one a worker process."""
    import tiktoken

    key = hashlib.sha256(f"{pattern}\0{file_text}".encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, file_text.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def pack_ids(docs: DataFrame, vocabulary: str, context: int = CONTEXT, group_rows: int = GROUP_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows: group, row, n_tokens, doc_ids, parts, cu_seqlens, ids and positions (little-endian uint32, `context` each,
    zero-padded). Reading all segments by (doc_id, part) gives every document's ids back."""
    spark = docs.sparkSession
    arrow_batches(spark, 1000)
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text_of(text_col))).alias("bytes")).first()
    groups = max(1, -(-size.rows // group_rows), -(-(size.bytes or 0) // GROUP_BYTES))
    with open(vocabulary, encoding="ascii") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(shared.value)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for group, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = np.asarray(encoder.encode_ordinary(text), "<u4")
                for part, start in enumerate(range(0, max(1, len(ids)), context)):
                    for column, x in zip(out, (group, doc, part, ids[start : start + context].tobytes())):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["group", "doc", "part", "ids"])

    def pack(table: pa.Table) -> pa.Table:
        cells = sorted(zip(*(table.column(c).to_pylist() for c in ("ids", "doc", "part", "group"))), key=lambda x: (-len(x[0]), x[1] is None, x[1] or 0, x[2]))
        columns: dict[str, list] = {f.split()[0]: [] for f in _PACKED.split(", ")}
        for row, members in enumerate(best_fit_decreasing([len(c[0]) // 4 for c in cells], context)):
            lengths = [len(cells[i][0]) // 4 for i in members]
            ids, positions = np.zeros(context, "<u4"), np.zeros(context, "<u4")
            ids[: sum(lengths)] = np.frombuffer(b"".join(cells[i][0] for i in members), "<u4")
            positions[: sum(lengths)] = np.concatenate([np.arange(n) for n in lengths])
            values = (cells[0][3], row, sum(lengths), [cells[i][1] for i in members], [cells[i][2] for i in members], [0, *np.cumsum(lengths).tolist()], ids.tobytes(), positions.tobytes())
            for column, x in zip(columns.values(), values):
                column.append(x)
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, k) for v, k in zip(columns.values(), kinds)], list(columns))

    numbered = docs.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("group"), F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text")
    )
    segments = numbered.mapInArrow(encode, "group int, doc long, part int, ids binary")
    return segments.groupBy("group").applyInArrow(pack, _PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as files: one row of the id matrix with its lengths and positions per record, by group."""
    packed.write.parquet(path)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_ids(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packed.select("group", "row", "n_tokens", "doc_ids", "parts", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))
