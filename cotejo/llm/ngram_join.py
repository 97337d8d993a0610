"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document is its set of distinct word n-grams, as 64-bit hashes. Let t be the threshold and e(n) = n - ceil(t n) the n-grams
that a set of n may hold beyond a linked partner's. Then, for linked sets and any global order of n-grams,

* the first e(n) + l(n) n-grams of each, for any rising l, share at least l(ceil(t n)) n-grams;
* within such prefixes, rarest first (document frequency in the prefixes, then hash), the sets share an n-gram among all but
  the last l(ceil(t n)) - 1. n-grams held once cannot be shared and fill that second prefix first;
* the first e(n) + 1 n-grams share one.

Short prefixes under the hash order (l = e / 2 + 1) are moved for all sets: most sets hold too few shared n-grams and end
here. Longer ones (l = 3 e + 1) under a second order are moved for the sets that are left; of them only the rarest shared
n-grams, about a third, pair documents, so passages that many documents hold do not. A third order is checked pair by pair.

A pair is a candidate only where all these filters meet, and is then verified on the whole sets. Texts of one set form a class
and take part once. The sets that share a rare n-gram meet as parity sketches of 512 bits: two sketches differ in at most as
many bits as the sets in n-grams, so pairs that differ in more bits than a link allows are left out without loss, and without
ever becoming rows (above some 2,500 n-grams they tell little, and pairs are left to the other filters). For the components,
each set first names its closest in another component, twice, with components found in between; then all pairs that are still
in different components are verified. A shared n-gram of many sets is cut into tiles of TILE sets, and each pair of tiles is a
task's group.

Links never leave a component, so all of them are counted there: each set is stored as its difference from one set of its
component, components are cut into tiles of bounded sets and n-grams, and each pair of tiles is a task's group, in which the
exact intersections of all pairs come from the n-grams that two differences share. Pairs never become rows.

Defined results: null or empty text has no n-grams, links with nothing and is its own component; a text of fewer words than
the n-gram length has its whole word sequence as one; rows that repeat a doc_id are separate documents of one component, and
equal sets link; a null doc_id is never the least; an empty table gives an empty result; very long texts only have more
n-grams; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import arrow_batches, fresh, lean, numbered, read_table, release, small_side, stage_table, text_of
from cotejo.llm.components import components

#: Words an n-gram and least similarity in percent, for uses without a contract of their own.
WORDS, PERCENT = 5, 80
#: Odd multipliers of the further orders: n-gram x is ranked by x * m mod 2 ** 64.
SECOND, THIRD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: l(n) of the first and second prefixes, as SQL and Python over e.
SHORT, LONG = "e div 2 + 1", "3 * e + 1"
#: Rounds in which each set only names its closest, sets a tile holds, and sets compared to a tile at once.
ROUNDS, TILE, STRIPE = 2, 2048, 256
#: n-grams of so few sets have all their pairs compared at once with those of others.
FEW = 64
#: n-grams and sets of a tile of a component, of which all links are counted.
TILE_GRAMS, TILE_SETS = 400_000, 2048
_SKETCH_WORDS = 8


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def spare(n: int, percent: int) -> int:
    return n - -(-percent * n // 100)


def short_prefix(n: int, percent: int) -> int:
    e = spare(n, percent)
    return e + e // 2 + 1


def long_prefix(n: int, percent: int) -> int:
    return 4 * spare(n, percent) + 1


def gram_set(text: str, words: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text; A-Z is lower-cased."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = (h ^ w[k : k + len(h)]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _sketch(words: int, percent: int):
    """(_at, _doc, _text) to (_at, _doc, _n, _class, _prefix): the prefix under the hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sizes, keys, prefixes = [], [], []
            for text in batch.column("_text").to_pylist():
                grams = gram_set(text, words, hashes)
                n = len(grams)
                sizes.append(n)
                keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                prefixes.append(grams[: short_prefix(n, percent)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_at"), batch.column("_doc"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(prefixes)], ["_at", "_doc", "_n", "_class", "_prefix"]
            )

    return lean(run)


def _first_by(grams: np.ndarray, multiplier: int, k: int) -> np.ndarray:
    return grams[np.argpartition(grams * np.uint64(multiplier), k - 1)[:k]] if 0 < k < len(grams) else grams


def _longer(words: int, percent: int):
    """(_at, _text) to (_at, _n, _prefix): the prefix under the second order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sets = [gram_set(t, words, hashes) for t in batch.column("_text").to_pylist()]
            longer = [_first_by(s, SECOND, long_prefix(len(s), percent)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("_at"), pa.array([len(s) for s in sets], pa.int64()), _lists(longer)], ["_at", "_n", "_prefix"])

    return lean(run)


def _whole(words: int, percent: int):
    """(_at, _text) to (_at, _n, _set, _third, _sketch): the set, its prefix under the third order, its parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sets = [gram_set(t, words, hashes) for t in batch.column("_text").to_pylist()]
            third = [_first_by(s, THIRD, spare(len(s), percent) + 1) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("_at"), pa.array([len(s) for s in sets], pa.int64()), _lists(sets), _lists(third), pa.array(map(parity_sketch, sets), pa.binary())], ["_at", "_n", "_set", "_third", "_sketch"])

    return lean(run)


def parity_sketch(grams: np.ndarray) -> bytes:
    """Bit b is the parity of the n-grams that fall on b."""
    bits = np.bincount(((grams * np.uint64(SECOND)) >> np.uint64(55)).astype(np.int64), minlength=64 * _SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _closest(percent: int, every: bool):
    """Rows (_tok, _i, _j, _tile, _at, _n, _sketch, _label), sorted by (_tok, _i, _j), to pairs (a, b) of different labels that
    sketches and sizes allow to link: all of them, or for each set the closest."""

    def stripe(left: np.ndarray, right: np.ndarray, at, n, sketch, label) -> tuple[np.ndarray, np.ndarray]:
        """(whether left and right may link, bits in which they differ) for all pairs of a few left rows with all right ones."""
        bits = np.zeros((len(left), len(right)), np.int32)
        for w in range(_SKETCH_WORDS):
            bits += np.bitwise_count(sketch[left, w][:, None] ^ sketch[right, w][None, :])
        a, b = n[left][:, None].astype(np.int32), n[right][None, :].astype(np.int32)
        # |A ^ B| = a + b - 2 o, and 100 o >= percent (a + b - o).
        ok = bits <= (a + b) - 2 * -(-percent * (a + b) // (100 + percent))
        ok &= (100 * a >= percent * b) & (100 * b >= percent * a) & (label[left][:, None] != label[right][None, :])
        return ok, bits

    def neighbours(group: np.ndarray, at, n, sketch, label) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """All pairs that may link within groups 0, 1, ... of a few adjacent rows; rows of group -1 are not looked at."""
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for step in range(1, FEW):
            x = np.flatnonzero((group[step:] == group[:-step]) & (group[step:] >= 0))
            if not len(x):
                break
            y = x + step
            x, y = (z[label[x] != label[y]] for z in (x, y))
            total = n[x] + n[y]
            near = (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent) & (np.bitwise_count(sketch[x] ^ sketch[y]).sum(1) <= total - 2 * -(-percent * total // (100 + percent)))
            a.append(np.minimum(at[x[near]], at[y[near]])), b.append(np.maximum(at[x[near]], at[y[near]]))
        return a, b

    def pairs_of(tile: np.ndarray, at: np.ndarray, n: np.ndarray, sketch: np.ndarray, label: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
        first = np.arange(len(at)) if own else np.flatnonzero(tile == tile.min())
        right = first if own else np.flatnonzero(tile != tile.min())
        far = 1 << 20
        best, near = np.full(len(right), far, np.int32), np.zeros(len(right), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for start in range(0, len(first), STRIPE):
            left = first[start : start + STRIPE]
            ok, bits = stripe(left, right, at, n, sketch, label)
            if every:
                if own:
                    ok &= left[:, None] < right[None, :]
                x, y = np.nonzero(ok)
                found.append((at[left[x]], at[right[y]]))
                continue
            bits[~ok] = far
            y = bits.argmin(1)
            keep = bits[np.arange(len(left)), y] < far
            found.append((at[left[keep]], at[right[y[keep]]]))
            if not own:
                x = bits.argmin(0)
                least = bits[x, np.arange(len(right))]
                better = least < best
                best[better], near[better] = least[better], at[left[x[better]]]
        if not every and not own:
            found.append((near[best < far], at[right[best < far]]))
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def flush(table: pa.Table) -> pa.RecordBatch:
            tok, i, j, tile, at, n, label = (table.column(c).to_numpy() for c in ("_tok", "_i", "_j", "_tile", "_at", "_n", "_label"))
            sketch = np.frombuffer(b"".join(table.column("_sketch").to_pylist()), np.uint64).reshape(-1, _SKETCH_WORDS)
            edges = np.flatnonzero((tok[1:] != tok[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(tok)]])
            few = (ends - starts <= FEW) & (i[starts] == j[starts])
            a, b = neighbours(np.repeat(np.where(few, np.arange(len(starts)), -1), ends - starts), at, n, sketch, label)
            for start, end in zip(starts[~few], ends[~few]):
                own = i[start] == j[start]
                if own or (tile[start:end] != tile[start]).any():
                    x, y = pairs_of(tile[start:end], at[start:end], n[start:end], sketch[start:end], label[start:end], own)
                    a.append(x), b.append(y)
            found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            # A group that may go on in the next batch waits.
            tok, i, j = (table.column(c).to_numpy() for c in ("_tok", "_i", "_j"))
            last = (tok == tok[-1]) & (i == i[-1]) & (j == j[-1])
            whole = len(tok) - int(last.sum())
            rest = table.slice(whole)
            if whole:
                yield flush(table.slice(0, whole))
        if rest is not None:
            yield flush(rest)

    return lean(run)


def _rare_first(tokens: DataFrame, label: str) -> DataFrame:
    """tokens (_at, _n, _least, _tok) that two sets at least hold, with their frequency _df, of sets that hold enough of them."""
    frequent = stage_table(tokens.groupBy("_tok").agg(F.count(F.lit(1)).alias("_df")).filter("_df > 1"), f"{label}-df")
    shared = tokens.join(frequent, "_tok")
    per_set = shared.groupBy("_at", "_n", "_least").agg(F.collect_list(F.struct("_df", "_tok")).alias("_held")).filter(F.size("_held") >= F.col("_least"))
    held = stage_table(per_set, f"{label}-held")
    release(frequent)
    return held


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) that link: further prefixes first, then the whole sets."""
    def side(x: str) -> DataFrame:
        return sets.select(*[F.col(c).alias(f"{c}_{x}") for c in ("_at", "_n", "_set", "_third")]).withColumnRenamed(f"_at_{x}", x)

    near = pairs.join(side("a"), "a").filter("a <> b").join(side("b"), "b")
    near = near.filter(F.least("_n_a", "_n_b") * 100 >= F.greatest("_n_a", "_n_b") * percent).filter(F.arrays_overlap("_third_a", "_third_b"))
    near = near.withColumn("_both", F.size(F.array_intersect("_set_a", "_set_b")))
    return near.filter(100 * F.col("_both") >= percent * (F.col("_n_a") + F.col("_n_b") - F.col("_both"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _components_of(docs: DataFrame, sets_of: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, label): the components of more than one set of sets_of (_at, _n, _prefix); and the stored sets of all nodes."""
    spark = docs.sparkSession

    def tokens(prefixes: DataFrame, least: str) -> DataFrame:
        e = f"(ceil({percent} * _n / 100D) - ceil({percent} * ceil({percent} * _n / 100D) / 100D))"  # of the least partner
        # No more than the least intersection, which l exceeds at thresholds below 67 percent.
        shared = f"least({least.replace('e', e, 1)}, ceil({percent} * _n / 100D))"
        return prefixes.select("_at", "_n", F.expr(shared).cast("long").alias("_least"), F.explode("_prefix").alias("_tok"))

    def texts_of(held: DataFrame) -> DataFrame:
        """Texts of the sets that are left, by position: a broadcast of their positions up to a bound, else a join."""
        arrow_batches(spark, 1000)
        return docs.select("_at", "_text").join(small_side(held.select("_at")), "_at", "left_semi")

    short = _rare_first(tokens(sets_of, SHORT), "short")
    longer = stage_table(texts_of(short).mapInArrow(_longer(words, percent), "_at long, _n long, _prefix array<long>"), "longer")
    long = _rare_first(tokens(longer, LONG), "long")
    release(short, longer)
    # Once more among the sets that are left: what only dropped sets held is no longer shared.
    held = _rare_first(long.select("_at", "_n", "_least", F.explode("_held._tok").alias("_tok")), "left")
    order = F.sort_array("_held")
    bucketed = held.select("_at", "_n", F.explode(F.slice(order, 1, F.size("_held") - F.col("_least").cast("int") + 1)).alias("t"))
    bucketed = stage_table(bucketed.select("_at", "_n", "t._tok"), "buckets")
    sets = stage_table(texts_of(held).mapInArrow(_whole(words, percent), "_at long, _n long, _set array<long>, _third array<long>, _sketch binary"), "sets")

    # Stored, so that the join below meets two plain exchanges and a hot n-gram's rows can be split.
    counts = stage_table(bucketed.groupBy("_tok").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1"), "bucket-sizes")
    tiled = bucketed.join(counts, "_tok").join(sets.select("_at", "_sketch"), "_at").withColumn("_tiles", F.expr(f"cast((_m + {TILE - 1}) div {TILE} AS int)"))
    tiled = tiled.withColumn("_tile", F.pmod(F.xxhash64("_at"), F.col("_tiles")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    tiled = tiled.select("_tok", F.least("_tile", "_other").alias("_i"), F.greatest("_tile", "_other").alias("_j"), "_tile", "_at", "_n", "_sketch")
    tiled = stage_table(tiled, "tiles")
    release(long, held, bucketed, counts)
    links = spark.createDataFrame([], "u long, v long")
    labels = spark.createDataFrame([], "node long, label long")
    for turn in range(ROUNDS + 1):
        named = tiled.join(labels.withColumnRenamed("node", "_at"), "_at", "left").withColumn("_label", F.coalesce("label", "_at")).drop("label")
        grouped = named.repartition("_tok", "_i", "_j").sortWithinPartitions("_tok", "_i", "_j")
        pairs = stage_table(grouped.mapInArrow(_closest(percent, turn == ROUNDS), "a long, b long").distinct(), "pairs")
        found = stage_table(_verified(pairs, sets, percent), "links")
        release(pairs)
        if found.limit(1).count():
            links = links.unionByName(found)
            labels = stage_table(components(links), "labels")
        elif turn < ROUNDS:
            continue
    release(tiled)
    return labels, sets


def _common(left: np.ndarray, right: np.ndarray, row: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """How many n-grams each left row shares with each right row; (row, gram) are the entries of all rows, each once.

    n-grams of many rows are counted by products of 0/1 matrices, those of few by their pairs.
    """
    rows = len(left) + len(right)
    side = np.full(int(max(left.max(), right.max())) + 1, -1)
    side[left], place = 0, np.zeros(len(side), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    own = len(left) == len(right) and (left == right).all()
    if not own:
        side[right] = 1
    order = np.argsort(gram, kind="stable")
    row, gram = row[order], gram[order]
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    holders = np.diff(np.concatenate([starts, [len(gram)]]))
    out = np.zeros((len(left), len(right)), np.float32)
    of_entry = np.repeat(np.arange(len(starts)), holders)
    many = np.flatnonzero(holders > FEW)
    for at in range(0, len(many), 2048):
        part = many[at : at + 2048]
        column = np.full(len(starts), -1)
        column[part] = np.arange(len(part))
        here = column[of_entry] >= 0
        hot = np.zeros((len(side), len(part)), np.float32)
        hot[row[here], column[of_entry[here]]] = 1
        out += hot[left] @ hot[right].T
    few = np.repeat((holders <= FEW) & (holders > 1), holders)
    row, of_entry = row[few], of_entry[few]
    for step in range(1, min(FEW, rows)):
        same = np.flatnonzero(of_entry[step:] == of_entry[:-step])
        if not len(same):
            break
        x, y = row[same], row[same + step]
        if own:
            x, y = np.concatenate([x, y]), np.concatenate([y, x])
        else:
            cross = side[x] != side[y]
            x, y = x[cross], y[cross]
            x, y = np.where(side[x] == 0, x, y), np.where(side[x] == 0, y, x)
        np.add.at(out, (place[x], place[y]), 1)
    return out


def _count_links(percent: int):
    """Rows (_label, _i, _j, _tile, _at, _n, _copies, _diff), sorted by the first three, to (_at, links): documents of other
    sets that each set links with, as far as the pair of tiles knows."""

    def links_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        tile, at, n, copies = (table.column(c).to_numpy() for c in ("_tile", "_at", "_n", "_copies"))
        diff = table.column("_diff").combine_chunks()
        size = pa.compute.list_value_length(diff).to_numpy()
        own = bool(table.column("_i")[0] == table.column("_j")[0])
        left = np.arange(len(at)) if own else np.flatnonzero(tile == tile.min())
        right = left if own else np.flatnonzero(tile != tile.min())
        if not len(right) or (own and len(at) < 2) or (not own and (tile == tile[0]).all()):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        common = _common(left, right, np.repeat(np.arange(len(at)), size), diff.flatten().to_numpy())
        total = (n[left][:, None] + n[right][None, :]).astype(np.int64)
        both = (total - (size[left][:, None] + size[right][None, :]) + 2 * common.astype(np.int64)) // 2
        link = 100 * both >= percent * (total - both)
        if own:
            np.fill_diagonal(link, False)
            return at, link @ copies
        return np.concatenate([at[left], at[right]]), np.concatenate([link @ copies[right], copies[left] @ link])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        rest: pa.Table | None = None

        def flush(table: pa.Table) -> pa.RecordBatch:
            keys = [table.column(c).to_numpy() for c in ("_label", "_i", "_j")]
            edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            found = [links_of(table.slice(a, b - a)) for a, b in zip([0, *edges], [*edges, table.num_rows])]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in (0, 1)], ["_at", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            keys = [table.column(c).to_numpy() for c in ("_label", "_i", "_j")]
            last = np.all([k == k[-1] for k in keys], axis=0)
            whole = table.num_rows - int(last.sum())
            rest = table.slice(whole)
            if whole:
                yield flush(table.slice(0, whole))
        if rest is not None:
            yield flush(rest)

    return lean(run)


def _links(labels: DataFrame, sets: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """(_at, links) of the sets of labels (node, label): documents of other sets that link with each. copies: (_at, _copies)."""
    heads = sets.join(labels.select(F.col("label").alias("_at")).distinct(), "_at").select(F.col("_at").alias("label"), F.col("_set").alias("_head"))
    members = sets.select("_at", "_n", "_set").join(labels.withColumnRenamed("node", "_at"), "_at").join(copies, "_at")
    differ = F.concat(F.array_except("_set", "_head"), F.array_except("_head", "_set"))
    diffs = stage_table(members.join(heads, "label").select("label", "_at", "_n", "_copies", differ.alias("_diff")), "diffs")
    tiles = diffs.groupBy("label").agg(F.expr(f"cast(greatest(ceil(sum(size(_diff)) / {TILE_GRAMS}), ceil(count(1) / {TILE_SETS})) AS int)").alias("_tiles"))
    tiles = stage_table(tiles, "link-tiles")
    tiled = diffs.join(tiles, "label").withColumn("_tile", F.pmod(F.xxhash64("_at"), F.col("_tiles")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    tiled = tiled.select(F.col("label").alias("_label"), F.least("_tile", "_other").alias("_i"), F.greatest("_tile", "_other").alias("_j"), "_tile", "_at", "_n", "_copies", "_diff")
    grouped = tiled.repartition("_label", "_i", "_j").sortWithinPartitions("_label", "_i", "_j")
    counted = grouped.mapInArrow(_count_links(percent), "_at long, links long").groupBy("_at").agg(F.sum("links").alias("links"))
    counted = stage_table(counted, "link-counts")
    release(diffs, tiles)
    return counted


def _near(rows: DataFrame, at: str, words: int, percent: int, id_col: str, text_col: str, count: bool) -> DataFrame:
    """One row per row of rows, whose numbers are in column `at`: _at, _doc, _n, component_id, first, n_links (null unless count)."""
    arrow_batches(rows.sparkSession, 1000)
    texts = rows.select(F.col(at).alias("_at"), F.col(id_col).cast("long").alias("_doc"), text_of(text_col).alias("_text"))
    sketched = stage_table(texts.mapInArrow(_sketch(words, percent), "_at long, _doc long, _n long, _class binary, _prefix array<long>"), "sketch")
    least = F.min(F.struct(F.col("_doc").isNull().alias("none"), "_doc", "_at")).alias("_first")
    classes = sketched.filter("_n > 0").groupBy("_class").agg(least, F.count(F.lit(1)).alias("_copies"))
    classes = stage_table(classes.select("_class", F.col("_first._at").alias("_rep"), F.col("_first._doc").alias("_rep_doc"), "_copies"), "classes")
    sets_of = sketched.join(small_side(classes).select(F.col("_rep").alias("_at")), "_at", "left_semi").select("_at", "_n", "_prefix")
    labels, sets = _components_of(texts, sets_of, words, percent)
    slim = stage_table(sketched.drop("_prefix"), "sizes")
    release(sketched)
    links = _links(labels, sets, classes.select(F.col("_rep").alias("_at"), "_copies"), percent) if count else None
    release(sets)
    named = classes.join(labels.withColumnRenamed("node", "_rep"), "_rep", "left").withColumn("label", F.coalesce("label", "_rep"))
    if links is not None:
        named = named.join(links.withColumnRenamed("_at", "_rep"), "_rep", "left")
    other = F.coalesce("links", F.lit(0)) if links is not None else F.lit(None)
    named = stage_table(named.withColumn("n_links", (F.col("_copies") - 1 + other).cast("long")), "named")
    head = named.groupBy("label").agg(F.min(F.struct(F.col("_rep_doc").isNull().alias("none"), "_rep_doc", "_rep")).alias("_head"))
    headed = stage_table(named.join(head, "label").select("_class", F.col("_head._rep_doc").alias("component_id"), F.col("_head._rep").alias("_keep"), "n_links"), "headed")
    alone = F.col("_n") == 0
    release(named)
    return slim.join(headed, "_class", "left").select(
        "_at",
        "_doc",
        "_n",
        F.when(alone, F.col("_doc")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("_keep") == F.col("_at"))).alias("first"),
        F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"),
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, n_links (documents it links with), first (the one row of its
    component to keep)."""
    at = fresh(docs, "_at")
    found = _near(numbered(docs, at), at, words, percent, id_col, text_col, count=True)
    return found.select(F.col("_doc").alias(id_col), F.col("_n").alias("n_shingles"), "component_id", "n_links", "first")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component."""
    at = fresh(docs, "_at")
    rows = numbered(docs, at)
    gone = _near(rows, at, words, percent, "doc_id", "text", count=False).filter("NOT first").select(F.col("_at").alias(at))
    return rows.join(small_side(stage_table(gone, "gone")), at, "left_anti").select(*docs.columns)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=90).drop("first")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS node, x AS other FROM both_ways UNION SELECT r.node, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
least AS (SELECT node, min(other) AS c FROM reach GROUP BY node),
held AS (SELECT x, count(*) AS n_links FROM both_ways GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON node = w.doc_id LEFT JOIN held ON x = w.doc_id
"""
