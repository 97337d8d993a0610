"""Quality classifier: interpolated modified Kneser-Ney n-grams of characters, trained on trusted text, by sharded count joins.

Texts are read as their characters, ORDER at a time; a text's start is padded. The n-grams of the trusted texts are counted by
(model, n-gram); lower orders count by how many characters an n-gram is preceded (n-grams that begin a text, by how often). Each
order's counts are joined with the totals and discounts of their contexts and with the order below, all by n-gram, so counts and
probabilities are tables that grow with the corpus and no task or driver holds a model. A language of MIN_DOCS trusted documents
has its own model, whatever their number; all others share one of all trusted text.

Scoring: documents form blocks of neighbouring rows. Each block asks for its distinct n-grams, once however often they occur; the
distinct ones of all blocks are joined with the tables, backing off where an n-gram is unseen; the answers go back to the blocks
and meet their compressed texts. A document's perplexity is the exponential of the mean negative log probability over its whole
text. A block is a fixed range of row numbers, so what a task holds does not grow with the table.

Thresholds: one trusted document in FOLDS, by a hash of its id, is kept out of training. Per language, the QUANTILE of these
documents' perplexity, times MARGIN, and times exp(SHORT / sqrt(n)) for a text of n characters, since the mean of few symbols is
noisy. A document above its threshold is rejected.

Defined results: null or empty text has no perplexity and is rejected; null lang, and a language with fewer than MIN_DOCS
trusted documents, take the pooled model and threshold; a doc_id that labels repeat is trusted if any of its rows is; without
any trusted text every non-empty document is kept; repeated rows are judged one by one; an empty table gives an empty result;
columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import arrow_batches, fresh, lean, numbered, read_table, release, small_side, stage_table, text_of

ORDER, BLOCK_BITS = 4, 13
MIN_DOCS, FOLDS, QUANTILE, MARGIN, SHORT = 30, 5, 0.995, 1.15, 2.5
POOLED = "*"
#: Stands before a text's first character; a text's own ones become U+FFFD.
PAD = "\u0002"
#: Quantiles are exact on steps of 1/1000 nat.
STEPS = 1000


def _points(texts: list[str]) -> np.ndarray:
    """The code points of all texts, each after its padding."""
    start = PAD * (ORDER - 1)
    return np.frombuffer((start + start.join(t.replace(PAD, "\ufffd") for t in texts)).encode("utf-32-le"), "<u4")


def _windows(points: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(points, ORDER)


def _codes(points: np.ndarray) -> np.ndarray:
    """The n-gram at each place as 64 bits: its code points where all are below U+10000, else a hash of them."""
    narrow = np.ascontiguousarray(points, "<u2")
    codes = np.ndarray((len(points) - ORDER + 1,), "<u8", narrow.tobytes(), 0, (2,)).copy()
    if len(points) and points.max() > 0xFFFF:
        windows = _windows(points)
        wide = np.flatnonzero((windows > 0xFFFF).any(1))
        h = np.zeros(len(wide), np.uint64)
        for k in range(ORDER):
            h = (h ^ windows[wide, k]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        codes[wide] = h
    return codes


def _distinct(points: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, list[str]]:
    """The distinct codes of the n-grams that end with a character and are not in known, and the n-grams."""
    ends = points[ORDER - 1 :] != ord(PAD)
    all_codes = _codes(points)
    codes = np.unique(all_codes[ends])
    if known is not None and len(known):
        codes = codes[~np.isin(codes, known)]
    if points.max(initial=0) <= 0xFFFF:
        flat = codes.view("<u2").astype("<u4").tobytes().decode("utf-32-le")
    else:
        order = np.argsort(all_codes, kind="stable")
        first = order[np.searchsorted(all_codes, codes, sorter=order)]
        flat = np.ascontiguousarray(_windows(points)[first]).tobytes().decode("utf-32-le")
    return codes, [flat[i : i + ORDER] for i in range(0, len(flat), ORDER)]


def _lookup(grams: list[str], logp: np.ndarray):
    """A function from padded code points, all of whose n-grams are among grams, to their log probabilities. Up to 256 characters
    it goes through tables of the first three characters and the fourth, else through a binary search."""
    points = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(-1, ORDER)
    alphabet = np.unique(points)
    if len(alphabet) > 256 or alphabet[-1] > 0xFFFF:
        codes = np.concatenate([_codes(p) for p in points])
        order = np.argsort(codes)
        codes, logp = codes[order], logp[order]
        return lambda p: logp[np.searchsorted(codes, _codes(p))]
    bits = max(1, int(len(alphabet) - 1).bit_length())
    number = np.zeros(1 << 16, np.int32)
    number[alphabet] = np.arange(len(alphabet))
    ids = number[points]
    heads, row = np.unique((ids[:, 0] << 2 * bits) | (ids[:, 1] << bits) | ids[:, 2], return_inverse=True)
    rows, cells = np.zeros(1 << 3 * bits, np.int32), np.zeros(len(heads) << bits, np.float32)
    rows[heads] = np.arange(len(heads))
    cells[(row << bits) | ids[:, 3]] = logp

    def look(p: np.ndarray) -> np.ndarray:
        i = number[p]
        return cells[(rows[(i[:-3] << 2 * bits) | (i[1:-2] << bits) | i[2:-1]] << bits) | i[3:]]

    return look


def _by_key(keys: list, texts: list[str]) -> dict[object, list[str]]:
    found: dict[object, list[str]] = {}
    for key, text in zip(keys, texts):
        found.setdefault(key, []).append(text)
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(model, text) to (model, gram, n), summed within a batch."""
    for batch in batches:
        for model, texts in _by_key(batch.column(0).to_pylist(), batch.column(1).to_pylist()).items():
            points = _points(texts)
            codes, grams = _distinct(points)
            _, n = np.unique(_codes(points)[points[ORDER - 1 :] != ord(PAD)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([model] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], ["model", "gram", "n"])


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, model, text) to the (block, model, gram) that the task has not asked for yet."""
    seen: dict[object, np.ndarray] = {}
    for batch in batches:
        groups = _by_key(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), batch.column(2).to_pylist())
        seen = {k: v for k, v in seen.items() if k in groups}
        for (block, model), texts in groups.items():
            old = seen.get((block, model), np.empty(0, np.uint64))
            codes, grams = _distinct(_points(texts), old)
            seen[(block, model)] = np.union1d(old, codes)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(grams), pa.int64()), pa.array([model] * len(grams), pa.string()), pa.array(grams, pa.string())], ["block", "model", "gram"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, ...) to (block, rows): the rows of each block in a batch as one compressed Arrow stream."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        names, packed = [], []
        for a, b in zip(edges, edges[1:]):
            if a < b:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    out.write_batch(batch.slice(a, b - a))
                names.append(int(blocks[a]))
                packed.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary())], ["block", "rows"])


def _score(packed: pa.Table, answers: pa.Table) -> pa.Table:
    """The packed rows of a block and its answers (model, gram, logp) to (_at, _doc, lang, model, n_chars, ce)."""
    tables = {}
    names = answers.column("model")
    for model in names.unique().to_pylist():
        part = answers.filter(pa.compute.equal(names, model))
        tables[model] = _lookup(part.column("gram").to_pylist(), part.column("logp").to_numpy())
    out = []
    for rows in packed.column("rows").to_pylist():
        batch = pa.ipc.open_stream(rows).read_all()
        entropy = []
        for model, text in zip(batch.column("model").to_pylist(), batch.column("text").to_pylist()):
            entropy.append(-float(tables[model](_points([text])).mean(dtype=np.float64)) if text and model in tables else None)
        n_chars = pa.array([len(t) for t in batch.column("text").to_pylist()], pa.int64())
        out.append(pa.table([batch.column(c) for c in ("_at", "_doc", "lang", "model")] + [n_chars, pa.array(entropy, pa.float64())], ["_at", "_doc", "lang", "model", "n_chars", "ce"]))
    schema = pa.schema([("_at", pa.int64()), ("_doc", pa.int64()), ("lang", pa.string()), ("model", pa.string()), ("n_chars", pa.int64()), ("ce", pa.float64())])
    return pa.concat_tables(out).cast(schema) if out else schema.empty_table()


def _discount(n: str) -> str:
    return f"CASE WHEN {n} >= 3 THEN d3 WHEN {n} = 2 THEN d2 ELSE d1 END"


def train(texts: DataFrame) -> tuple[dict[int, DataFrame], dict[int, DataFrame], DataFrame]:
    """(model, text) to the stored tables of the models: by order k, (model, gram, p) of the seen n-grams and (model, context,
    kinds, total, bow), the weight that a context leaves to the order below; and (model, unknown), the probability of a
    character never seen."""
    arrow_batches(texts.sparkSession, 1000)
    counted = texts.mapInArrow(lean(_count), "model string, gram string, n long")
    own = stage_table(counted.groupBy("model", "gram").agg(F.sum("n").alias("n")), "grams")
    pooled = own.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("model"), "gram", "n")
    levels = {ORDER: stage_table(own.filter(F.col("model") != POOLED).unionByName(pooled), f"counts-{ORDER}")}
    release(own)
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[k + 1].groupBy("model", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("preceded"), F.sum("n").alias("n"))
        levels[k] = stage_table(shorter.select("model", "gram", F.when(F.col("gram").startswith(PAD), F.col("n")).otherwise(F.col("preceded")).alias("n")), f"counts-{k}")
    seen: dict[int, DataFrame] = {}
    backoff: dict[int, DataFrame] = {}
    unknown = None
    for k in range(1, ORDER + 1):
        # Chen and Goodman's closed form, each discount within 0 and its count.
        of = levels[k].groupBy("model").agg(*[F.count_if(F.col("n") == j).cast("double").alias(f"n{j}") for j in (1, 2, 3, 4)], F.count(F.lit(1)).alias("kinds"))
        y = "if(n1 + 2 * n2 > 0, n1 / (n1 + 2 * n2), 0.5D)"
        forms = [f"if(n{j} > 0, least({j}D, greatest(0D, {j} - {j + 1} * {y} * n{j + 1} / n{j})), {j} * 0.5D) AS d{j}" for j in (1, 2, 3)]
        of = stage_table(of.selectExpr("model", "kinds", *forms), f"discounts-{k}")
        cells = levels[k].join(small_side(of), "model").withColumn("d", F.expr(_discount("n"))).withColumn("context", F.expr(f"substring(gram, 1, {k - 1})"))
        contexts = cells.groupBy("model", "context", "kinds").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        contexts = stage_table(contexts.select("model", "context", "kinds", "total", (F.col("left") / F.col("total")).alias("bow")), f"contexts-{k}")
        joined = cells.drop("kinds").join(contexts, ["model", "context"])
        if k == 1:
            uniform = F.col("bow") / (F.col("kinds") + 1)
            unknown = stage_table(contexts.select("model", uniform.alias("unknown")), "unknown")
            lower = uniform
        else:
            below = seen[k - 1].select("model", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            joined = joined.withColumn("suffix", F.expr("substring(gram, 2)")).join(below, ["model", "suffix"])
            lower = F.col("bow") * F.col("below")
        seen[k] = stage_table(joined.select("model", "gram", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + lower).alias("p")), f"seen-{k}")
        backoff[k] = contexts
        release(of)
    release(*levels.values())
    return seen, backoff, unknown


def log_probabilities(asked: DataFrame, seen: dict[int, DataFrame], backoff: dict[int, DataFrame], unknown: DataFrame) -> DataFrame:
    """Distinct (model, gram) to (model, gram, logp), without those of models that have no text."""
    found = asked.join(small_side(unknown), "model")
    p = F.col("unknown")
    for k in range(1, ORDER + 1):
        tail = f"substring(gram, {ORDER - k + 1}, {k})"
        found = found.withColumn("_tail", F.expr(tail)).join(seen[k].select("model", F.col("gram").alias("_tail"), F.col("p").alias(f"p{k}")), ["model", "_tail"], "left").drop("_tail")
        if k > 1:
            found = found.withColumn("_context", F.expr(f"substring(gram, {ORDER - k + 1}, {k - 1})"))
            found = found.join(backoff[k].select("model", F.col("context").alias("_context"), F.col("bow").alias(f"b{k}")), ["model", "_context"], "left").drop("_context")
            p = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"b{k}"), F.lit(1.0)) * p)
        else:
            p = F.coalesce(F.col("p1"), p)
    return found.select("model", "gram", F.log(p).cast("float").alias("logp"))


def _trusted_ids(labels: DataFrame) -> DataFrame:
    """(_doc, _held) of the documents labelled of quality 1 and not toxic; _held: kept out of training."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_doc")).distinct()
    return stage_table(good.withColumn("_held", F.pmod(F.xxhash64("_doc"), F.lit(FOLDS)) == 0), "trusted-ids")


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(model, ce) of held-out trusted documents to (model, bound): the greatest accepted cross entropy, for POOLED from all."""
    steps = scored.filter("ce IS NOT NULL").select(F.explode(F.array_distinct(F.array(F.col("model"), F.lit(POOLED)))).alias("model"), F.floor(F.col("ce") * STEPS).alias("step"))
    # Its buffer holds counts by step of 1/1000 nat: their number does not depend on the input.
    found = steps.groupBy("model").agg(F.expr(f"percentile_disc({quantile}) WITHIN GROUP (ORDER BY step)").alias("step"))
    return found.select("model", ((F.col("step") + 1) / STEPS + float(np.log(MARGIN))).alias("bound"))


def _judged(rows: DataFrame, at: str, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(_at, _doc, lang, perplexity, threshold, kept): one row per row of rows, whose numbers are in column `at`. Stored."""
    spark = rows.sparkSession
    arrow_batches(spark, 1000)
    ids = _trusted_ids(labels)
    few_ids = small_side(ids)
    docs = rows.select(F.col(at).alias("_at"), F.col(id_col).cast("long").alias("_doc"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    own = docs.join(few_ids, "_doc").filter("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(f"n >= {MIN_DOCS}")
    own = small_side(stage_table(own.select("lang", F.col("lang").alias("_model")), "languages"))
    docs = docs.join(own, "lang", "left").withColumn("model", F.coalesce("_model", F.lit(POOLED)))
    model = train(docs.join(few_ids.filter("NOT _held"), "_doc").filter("text <> ''").select("model", "text"))
    blocked = docs.withColumn("block", F.shiftright("_at", BLOCK_BITS))
    asked = stage_table(blocked.filter("text <> ''").select("block", "model", "text").mapInArrow(lean(_ask), "block long, model string, gram string"), "asked")
    known = stage_table(log_probabilities(asked.select("model", "gram").distinct(), *model), "answers")
    release(*model[0].values(), *model[1].values(), model[2])
    packed = blocked.select("block", "_at", "_doc", "lang", "model", "text").mapInArrow(lean(_pack), "block long, rows binary")
    answers = asked.join(known, ["model", "gram"])
    scored = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score, "_at long, _doc long, lang string, model string, n_chars long, ce double")
    scored = stage_table(scored, "scored")
    release(asked, known)
    bounds = stage_table(thresholds(scored.join(small_side(ids).filter("_held"), "_doc").select("model", "ce")), "bounds")
    pooled: Column = F.first(F.when(F.col("model") == POOLED, F.col("bound")), ignorenulls=True)
    general = bounds.agg(pooled.alias("general")).first().general
    bound = F.coalesce("bound", F.lit(general).cast("double")) + F.lit(SHORT) / F.sqrt(F.greatest("n_chars", F.lit(1)))
    joined = scored.join(small_side(bounds), "model", "left").withColumn("_bound", bound)
    kept = (F.col("n_chars") > 0) & F.coalesce(F.col("ce") <= F.col("_bound"), F.lit(True))
    return joined.select("_at", "_doc", "lang", F.exp("ce").alias("perplexity"), F.exp("_bound").alias("threshold"), kept.alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id_col, lang, perplexity, threshold (double), kept (boolean)."""
    at = fresh(docs, "_at")
    return _judged(numbered(docs, at), at, labels, id_col, text_col, lang_col).drop("_at").withColumnRenamed("_doc", id_col)


def keep_fluent(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rejected rows."""
    at = fresh(docs, "_at")
    rows = numbered(docs, at)
    gone = _judged(rows, at, labels, "doc_id", "text", "lang").filter("NOT kept").select(F.col("_at").alias(at))
    return rows.join(small_side(stage_table(gone, "rejected")), at, "left_anti").select(*docs.columns)


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
