import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cotejo.llm import best_fit, bpe, common, exact_dedup, kneser_ney, length_buckets, license_scan, ngram_join, pii, quality_rules, sharding
from cotejo.llm.components import components
from cotejo.llm.registry import ORACLE_SQL, QUERIES
from tests.compare import same
from tests.conftest import SF
from tests.llm import brute

TOKENIZERS = "/opt/tokenizers"
HARD = [
    (0, "The licence of this text is given under the MIT License, as the others are.", "en", "a"),
    (1, None, None, None),
    (2, "", "en", ""),
    (3, "The licence  of this\ttext is given under the MIT License, as the others are.", "en", "a"),
    (None, "Write to ann@example.org or +44 20 7946 0958, 10.0.0.1, card 4111 1111 1111 1111!", "xx", "b"),
    (5, "word " * 30_000, "en", "a"),
    (5, "word " * 30_000, "en", "a"),
    (6, "x" * 50_000, "de", "a"),
    (7, "Zwei Zeilen\nZwei Zeilen\n\n  \nÄrger 🙂 Ω", "de", "b"),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string").withColumn("_at", F.lit("clash")).withColumn("kept", F.lit(1)).withColumn("n_words", F.lit("x")).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 1, None), (5, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name], duck)


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))


# ---- sharding


def test_shards_mirror_the_mixture(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    rows = sharding.stratified_interleave(df, 40, carry=["source"]).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 2000 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    for source, n in Counter(r.source for r in rows).items():
        per = Counter(r.shard for r in rows if r.source == source)
        assert all(abs(per[s] - n / 40) <= 1.5 for s in range(40))


def test_sharding_of_hard_rows(hard, empty):
    rows = sharding.stratified_interleave(hard, 4).collect()
    assert len(rows) == len(HARD) and {r.shard for r in rows} == {0, 1, 2, 3}
    assert sharding.stratified_interleave(empty).count() == 0


# ---- quality rules


def test_rules_of_hard_rows(hard, empty):
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.measures(hard.drop("n_words")).collect()}
    assert rows[(1, 0)].word_chars == 0 and rows[(5, 30_000)].n_repeat_words == 30_000
    line = rows[(7, 7)] if (7, 7) in rows else rows[(7, 8)]
    assert line.n_dup_lines == 1 and line.n_lines == 3
    assert quality_rules.measures(empty).count() == 0


def test_repeat_words_against_plain_counts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    rows = quality_rules.measures(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")).collect()
    for r in rows:
        w = texts[r.doc_id].split()
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        assert r.n_repeat_words == len(covered)


def test_rule_table():
    rule = quality_rules.Rule("r", "a", "b", 10, 20)
    assert rule.passes() == "(b = 0 OR (100 * a >= 10 * b AND 100 * a <= 20 * b))"


# ---- exact deduplication


def test_chunks_depend_on_content():
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcdefgh ") for _ in range(60_000))
    ends = exact_dedup.cut_points(data)
    assert ends[-1] == len(data) and all(b - a <= exact_dedup.MAX_CHUNK for a, b in itertools.pairwise([0, *ends]))
    chunks = lambda d: {d[a:b] for a, b in itertools.pairwise([0, *exact_dedup.cut_points(d)])}
    moved = chunks(b"a new beginning " + data)
    assert len(chunks(data) & moved) > 0.8 * len(moved)
    assert exact_dedup.cut_points("é".encode() * 20_000)[-1] == 40_000


@pytest.mark.parametrize("digest_size,most", [(16, 1000), (1, 1000), (1, 3)])
def test_equal_texts(spark, monkeypatch, digest_size, most):
    """Digests of one byte collide; identifiers stay verified, also beyond the digests that tasks are told of."""
    monkeypatch.setattr(exact_dedup, "MAX_UNVERIFIED", most)
    rng = random.Random(2)
    texts = [rng.choice(["one", "two", "three"]) * rng.randrange(1, 900) for _ in range(60)]
    rows = exact_dedup.classes_of_equal_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), digest_size=digest_size).collect()
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    assert all((r.keep_id, r.group_size, r.kept) == (first[texts[r.doc_id]], texts.count(texts[r.doc_id]), first[texts[r.doc_id]] == r.doc_id) for r in rows)


def test_dedup_of_hard_rows(hard, empty):
    rows = exact_dedup.classes_of_equal_texts(hard).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.text_sha256].append(r)
    assert len(rows) == len(HARD) and all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
    assert {(r.doc_id, r.keep_id) for r in rows if r.doc_id in (0, 3, 1, 2)} == {(0, 0), (3, 0), (1, 1), (2, 1)}
    assert {r.text_sha256 for r in rows} == {hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t, _, _ in HARD}
    assert exact_dedup.classes_of_equal_texts(empty).count() == 0


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path):
    """How files are split changes between the jobs of one call; numbers, drops and components stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(6).write.parquet(str(tmp_path / "docs"))
    many = spark.read.parquet(str(tmp_path / "docs"))
    seen = []
    try:
        for parts in ("2", "16"):
            spark.conf.set("spark.sql.files.minPartitionNum", parts)
            seen.append({(r.doc_id, r.n) for r in common.numbered(many, "n").select("doc_id", "n").collect()})
        rows = common.numbered(many, "n")
        spark.conf.set("spark.sql.files.minPartitionNum", "3")
        seen.append({(r.doc_id, r.n) for r in rows.select("doc_id", "n").collect()})
        dropped = exact_dedup.drop_equal_texts(many)
        spark.conf.set("spark.sql.files.minPartitionNum", "11")
        kept = {r.keep_id for r in exact_dedup.classes_of_equal_texts(docs).collect()}
        assert dropped.count() == len(kept)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert seen[0] == seen[1] == seen[2] and len({n for _, n in seen[0]}) == docs.count()


def test_stored_input_is_not_deleted(spark, hard):
    """A stored table is read again after each helper; its own columns, clashing ones included, come back."""
    stored = common.stage_table(hard, "input")
    for helper in (exact_dedup.drop_equal_texts, ngram_join.drop_near_duplicates, pii.sanitise):
        out = helper(stored)
        assert out.columns == hard.columns and {r._at for r in out.collect()} == {"clash"}
    assert stored.count() == len(HARD)


# ---- n-gram join


def plain_components(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    parent, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
            links[i] += 1
            links[j] += 1
    return [find(i) for i in range(len(sets))], [len(s) for s in sets], links


@pytest.mark.parametrize("words,percent,tile", [(3, 90, 2048), (5, 80, 2048), (2, 70, 8), (3, 90, 8), (3, 55, 8)])
def test_components_and_links_against_all_pairs(spark, monkeypatch, words, percent, tile):
    for name, value in (("TILE", tile), ("TILE_SETS", tile), ("FEW", 64 if tile > 8 else 3)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(words * percent)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))]
        for _ in range(25):  # chains of small changes: links between neighbours only
            if rng.random() < 0.6:
                base = list(base)
                for _ in range(rng.randrange(0, 3)):
                    base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base).upper() if rng.random() < 0.1 else " ".join(base))
    texts += ["", None, "one", "one", "two words", "Two  Words"]
    want, sizes, links = plain_components(texts, words, percent)
    rows = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words, percent).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.n_links) for r in rows} == {i: x for i, x in enumerate(zip(want, sizes, links))}
    assert Counter(r.component_id for r in rows if r["first"]) == Counter(set(want))


def test_near_duplicates_of_hard_rows(hard, empty):
    rows = ngram_join.near_duplicates(hard, 3, 90).collect()
    assert len(rows) == len(HARD) and {(r.doc_id, r.component_id) for r in rows if r.doc_id in (0, 3, 5)} == {(0, 0), (3, 0), (5, 5)}
    assert {r.n_shingles for r in rows if r.doc_id in (1, 2)} == {0}
    assert ngram_join.near_duplicates(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)}


# ---- Kneser-Ney


def plain_model(texts, order=4):
    """Interpolated modified Kneser-Ney as dictionaries; returns the probability of an n-gram."""
    pad = kneser_ney.PAD
    counts = {order: Counter(t[i : i + order] for t in (pad * (order - 1) + x for x in texts) for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        preceded, raw = Counter(g[1:] for g in counts[k + 1]), Counter()
        for g, n in counts[k + 1].items():
            raw[g[1:]] += n
        counts[k] = {g: raw[g] if g[0] == pad else n for g, n in preceded.items()}
    tables = {}
    for k, own in counts.items():
        c = [0] + [sum(v == j for v in own.values()) for j in (1, 2, 3, 4)]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0.5
        d = [0] + [min(j, max(0.0, j - (j + 1) * y * c[j + 1] / c[j])) if c[j] else j * 0.5 for j in (1, 2, 3)]
        total, left = Counter(), Counter()
        for g, n in own.items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(3, n)]
        tables[k] = own, d, total, left

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        own, d, total, left = tables[len(gram)]
        n, context = own.get(gram, 0), gram[:-1]
        if not total[context]:
            return p(gram[1:])
        return (max(0, n - d[min(3, n)]) + left[context] * p(gram[1:])) / total[context]

    return p


def grams_of(text, order=4):
    t = kneser_ney.PAD * (order - 1) + text
    return [t[i : i + order] for i in range(len(text))]


def test_joined_model_is_the_plain_one(spark):
    rng = random.Random(5)
    texts = {"en": ["".join(rng.choice(["the ", "cat ", "sat ", "on ", "a ", "mat. "]) for _ in range(60)) for _ in range(6)], "ru": ["".join(rng.choice(["кот ", "сел ", "на "]) for _ in range(40)) for _ in range(5)]}
    model = kneser_ney.train(spark.createDataFrame([(lang, t) for lang, own in texts.items() for t in own], "model string, text string"))
    asked = sorted({g for own in texts.values() for t in own for g in grams_of(t)} | {"zzzz", "the\u4e2d", "\u4e2dthe", "catт", "кото", kneser_ney.PAD * 3 + "q"})
    frame = spark.createDataFrame([(m, g) for m in ("en", "ru", "*", "none") for g in asked], "model string, gram string")
    got = {(r.model, r.gram): r.logp for r in kneser_ney.log_probabilities(frame, *model).collect()}
    assert {m for m, _ in got} == {"en", "ru", "*"}
    for name, own in (*texts.items(), ("*", texts["en"] + texts["ru"])):
        p = plain_model(own)
        for g in asked:
            assert got[name, g] == pytest.approx(float(np.log(p(g))), rel=1e-4)
        symbols = {c for t in own for c in t} | {"\u4e2d"}
        assert sum(p("the"[:3] + c) for c in symbols) == pytest.approx(1, abs=1e-9)


def test_verdict_against_a_plain_one(spark, monkeypatch):
    """Perplexities, thresholds and verdicts of two languages, blocks of 4 rows, and 33 further languages that share a model."""
    monkeypatch.setattr(kneser_ney, "MIN_DOCS", 5)
    monkeypatch.setattr(kneser_ney, "BLOCK_BITS", 2)
    rng = random.Random(6)
    words = {"en": "the cat sat on a mat and then it ran to the old house".split(), "ru": "кот сел на старый дом и потом ушёл".split()}
    good = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(60)) + "."
    docs = [(i, good("en" if i % 2 else "ru"), "en" if i % 2 else "ru") for i in range(120)]
    docs += [(200 + i, "".join(rng.choice("#$%&*!§@ZQX|") for _ in range(300)), "en") for i in range(10)] + [(300, None, None), (301, good("en"), None), (302, "", "en")]
    docs += [(310 + i, "".join(rng.sample(list(good("ru")), 200)), "ru") for i in range(5)] + [(400 + i, good("en"), f"l{i}") for i in range(33)]
    labelled = [(i, 1, 0) for i in range(80)] + [(90, 0, 0), (91, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in kneser_ney.judge(frame, spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")).collect()}
    ids = spark.createDataFrame([(i,) for i in range(80)], "d long").selectExpr("d", f"pmod(xxhash64(d), {kneser_ney.FOLDS}) = 0 AS held").collect()
    held = {r.d for r in ids if r.held}
    text_of = {i: t for i, t, _ in docs}
    models = {m: plain_model([text_of[i] for i in range(80) if i not in held and (m == "*" or m == ("en" if i % 2 else "ru"))]) for m in ("en", "ru", "*")}
    entropy = lambda m, t: -sum(np.log(models[m](g)) for g in grams_of(t)) / len(t)
    steps = {m: sorted(int(entropy("en" if i % 2 else "ru", text_of[i]) * 1000 // 1) for i in held if m == "*" or m == ("en" if i % 2 else "ru")) for m in models}
    for i, t, lang in docs:
        if not t:
            assert not rows[i].kept and rows[i].perplexity is None
            continue
        m = lang if lang in ("en", "ru") else "*"
        ce = entropy(m, t)
        bound = (steps[m][-1] + 1) / 1000 + np.log(kneser_ney.MARGIN) + kneser_ney.SHORT / len(t) ** 0.5
        assert rows[i].perplexity == pytest.approx(np.exp(ce), rel=1e-3) and np.log(rows[i].threshold) == pytest.approx(bound, abs=2e-3)
        assert rows[i].kept == (rows[i].perplexity <= rows[i].threshold)
    assert all(rows[i].kept for i in [*range(120), 301]) and not any(rows[200 + i].kept for i in range(10)) and not any(rows[310 + i].kept for i in range(5))


def test_classifier_of_hard_rows(hard, empty, labels):
    assert kneser_ney.judge(hard, labels).count() == len(HARD)
    assert kneser_ney.judge(empty, labels).count() == 0
    kept = kneser_ney.judge(hard, labels.filter("false")).filter("kept").count()
    assert kept == sum(1 for r in HARD if r[1])
    assert kneser_ney.keep_fluent(hard, labels.filter("false")).columns == hard.columns


# ---- personal data


def test_base_spans_against_plain_regexes(spark):
    rng = random.Random(7)
    parts = ["a", "Z", "_", "%", "@", "@", ".", ".", "-", "+", "1", "4", "255", "256", " ", "(", ")", "é", "\n", "🙂", "4111 1111 1111 1111", "+44 20 7946 0958", "1.2.3.4", "x@y.z", "\x01", "\x02", "\x03"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(1500)]
    texts += [None, "", "1 " * 20_000, "a@" + "b." * 20_000 + "c", "9" * 40_000, "1.1.1.1." * 5_000]
    rows = pii.base_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "_spans").collect()
    for r in rows:
        assert [(s.start, s.rank, s.kind, s.end) for s in r._spans] == brute.base_spans(texts[r.doc_id])


def test_telling_terms_are_removed(spark):
    filler = ["green", "house", "river", "stone", "light"]
    rows = [(i, f"Ask Zebulon about it: ann@example.org is the mail for {filler[i % 5]} things") for i in range(4)]
    rows += [(10 + i, f"Ask about it: the {filler[i % 5]} mail is for things of {filler[(i + 1) % 5]}") for i in range(60)] + [(99, "Zebra crossing"), (100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [rows[r.doc_id][1][t.start : t.end] for t in r._terms] for r in pii.annotate(docs).collect() if r._terms}
    assert set(found) == {0, 1, 2, 3} and all("Zebulon" in f and "mail" not in f and "about" not in f for f in found.values())
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zebulon" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == rows[4][1] and clean[99] == "Zebra crossing" and clean[100] is None


def test_telling_terms_far_from_the_entity_go_everywhere(spark):
    far = " and".join([" so the things of the river go on"] * 8)
    rows = [(i, f"Zebulon said{far} to ann@example.org, says ZEBULON. Bob-ann@example.org") for i in range(4)]
    rows += [(5, f"Zebulon, without the address{far}")] + [(10 + i, f"without the address said Bob to{far} says example number {i}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    found = {r.doc_id: [texts[r.doc_id][t.start : t.end] for t in r._terms] for r in pii.annotate(docs).collect() if r._terms}
    assert found == {0: ["Zebulon", "ZEBULON"], 1: ["Zebulon", "ZEBULON"], 2: ["Zebulon", "ZEBULON"], 3: ["Zebulon", "ZEBULON"], 5: ["Zebulon"]}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "zebulon" not in " ".join(clean.values()).lower() and clean[10] == texts[10]


def test_personal_data_of_hard_rows(hard, empty):
    rows = {r.doc_id: r for r in pii.annotate(hard).collect()}
    assert [s.kind for s in rows[None]._spans] == ["email", "phone", "ip", "card"]
    assert pii.sanitise(hard).count() == len(HARD) and pii.annotate(empty).count() == 0 and pii.sanitise(empty).count() == 0


# ---- packing


def test_boundaries_are_optimal():
    rng = random.Random(8)
    for _ in range(150):
        lengths = sorted(rng.sample(range(1, 30), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = rng.randrange(1, 6)
        cost = lambda b: sum(c * min(x for x in b if x >= n) for n, c in zip(lengths, counts))  # noqa: B023, E731
        found = length_buckets.optimal_boundaries(lengths, counts, k)
        assert cost(found) == min(cost(x) for j in range(1, k + 1) for x in itertools.combinations(lengths, j) if x[-1] == lengths[-1])
    assert length_buckets.optimal_boundaries([], [], 3) == []


def check_buckets(rows, texts, max_tokens, budget):
    parts = defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        assert r.n_tokens <= r.bucket_tokens and r.padding == r.bucket_tokens - r.n_tokens
    for doc, text in texts.items():
        own = sorted(parts[doc], key=lambda r: r.part)
        assert sum(r.n_tokens for r in own) == len((text or "").split()) and [r.start for r in own] == [i * max_tokens for i in range(len(own))]
    batches = defaultdict(list)
    for r in rows:
        batches[r.batch].append(r)
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        assert len({r.bucket_tokens for r in b}) == 1 and (len(b) == 1 or len(b) * b[0].bucket_tokens <= budget)
        assert sorted(r.slot for r in b) == list(range(len(b)))


def test_length_buckets(spark, hard, empty):
    rng = random.Random(9)
    texts = {i: "w " * rng.randrange(0, 300) for i in range(300)}
    rows = length_buckets.pack_by_length(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), max_tokens=100, buckets=5, batch_tokens=700).collect()
    check_buckets(rows, texts, 100, 700)
    assert len({r.bucket_tokens for r in rows}) == 5
    assert length_buckets.pack_by_length(hard).count() == len(HARD) + 2 * (-(-30_000 // 2048) - 1)
    assert length_buckets.pack_by_length(empty).count() == 0


def test_best_fit_against_a_plain_search():
    rng = random.Random(10)
    for _ in range(150):
        size = rng.randrange(5, 40)
        lengths = sorted((rng.randrange(0, size + 1) for _ in range(rng.randrange(1, 60))), reverse=True)
        free = []
        for n in lengths:
            fits = [(f - n, k) for k, f in enumerate(free) if f >= n]
            if fits:
                free[min(fits)[1]] -= n
            else:
                free.append(size - n)
        rows = best_fit.best_fit_decreasing(lengths, size)
        assert sorted(size - sum(lengths[i] for i in r) for r in rows) == sorted(free)


def byte_encoder():
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", encoding="ascii") as f:
        return best_fit.byte_encoder(f.read())


def test_packed_rows_give_every_document_back(spark, hard, empty, tmp_path):
    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    packed = best_fit.pack_ids(hard.withColumn("doc_id", F.coalesce("doc_id", F.lit(4)) + F.monotonically_increasing_id() * 100), path, context=512)
    best_fit.write_packed(packed, str(tmp_path / "packed"))
    segments = defaultdict(dict)
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(positions) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 512 and not ids[r.n_tokens :].any()
        for doc, part, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:]):
            segments[doc][part] = ids[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
    texts = [byte_encoder().decode(list(itertools.chain.from_iterable(p[k] for k in sorted(p)))) for p in segments.values()]
    assert Counter(texts) == Counter(t or "" for _, t, _, _ in HARD)
    assert best_fit.pack_ids(empty, path).count() == 0


# ---- tokenizer


def tokenizer():
    return bpe.WordTokenizer(bpe.vocabulary_text(f"{TOKENIZERS}/word_bpe_49k.json"))


def test_automaton_matches_the_library():
    from tokenizers import Tokenizer

    library, mine, rng = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json"), tokenizer(), random.Random(11)
    texts = ["", "ΑΣ ΣΑΣ İstanbul ǅ ﬁ Å é <|endoftext|>x<|startoftext|> <|endoftext|", "aaaa aaaaaaaaaaaaa bananana nrrrrra 's 'T they'RE 12345 ½ ²  x\x1c\x85y", "日本語 🙂🙂 नमस्ते a\x00b"]
    texts += ["".join(rng.choice("aehnrst") for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdé ñüß.,'1!ЖжΩ") for _ in range(80)) for _ in range(300)] + [t or "" for _, t, _, _ in HARD]
    for text, known in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = mine.encode(text)
        assert ids == known.ids
        assert mine.decode(ids) == library.decode(known.ids, skip_special_tokens=False)


def test_merge_gadgets_on_a_small_language():
    """All words of a small alphabet against the rules applied one by one."""
    merges = [("a", "b"), ("a", "a"), ("ab", "a"), ("b", "b"), ("aa", "ab"), ("bb", "a")]
    vocab = {t: i for i, t in enumerate(["a", "b", *[x + y for x, y in merges]])}
    automaton = bpe.MergeAutomaton(vocab, merges)

    def plain(word):
        parts = list(word)
        for x, y in merges:
            i = 0
            while i < len(parts) - 1:
                if parts[i] == x and parts[i + 1] == y:
                    parts[i : i + 2] = [x + y]
                i += 1
        return [vocab[p] for p in parts]

    for n in range(1, 11):
        for word in map("".join, itertools.product("ab", repeat=n)):
            assert automaton.encode_word(word) == plain(word)
            assert automaton.emit(automaton.encode_word(word)) == word


def test_tokenizer_query(spark, hard, empty):
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    digests = {(r.doc_id, r.ids_sha256, r.n_tokens) for r in bpe.digest_documents(hard, path).collect()}
    whole = bpe.encode_documents(hard, path).collect()
    assert digests == {(r.doc_id, hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest(), len(r.ids)) for r in whole}
    assert bpe.digest_documents(empty, path).count() == 0


# ---- licences


def test_license_places(spark):
    texts = [
        "Under the MIT license. under the mit  LICENSE", "under the mit", "Apache License, Version 2.0", "cc-by-nc cc by nc by nc", "xunder the mit licensé",
        "Permission is hereby granted, free of charge, to any person kindly obtaining a copy of this software and the associated documentation files", None, "",
    ]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows] == [(2, 0, 4, "mit"), (0, None, None, ""), (1, 0, 0, "apache-2"), (2, 0, 3, "cc-by-nc"), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (0, None, None, "")]
    assert rows[5].labels == "mit-text" and 0.6 <= rows[5].score < 1 and rows[0].score == 1.0


def test_repeated_openings_are_no_licence(spark):
    texts = ["licensed under the " * 20, "on the terms of the gnu and " * 30, "this software and that of this software and " * 12, "payment is due under the terms of the plan\n" * 4]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.labels, r.score) for r in rows] == [("", 0.0)] * 4


def test_license_spans_against_a_plain_aligner(spark):
    """Templates with words dropped, added and changed, and their words shuffled, against all bands of all diagonals."""
    rng = random.Random(12)
    known, gram, gap = license_scan.templates(), license_scan.GRAM, license_scan.MERGE_GAP
    texts = []
    for n in range(120):
        words = list(rng.choice(known).words)
        for _ in range(rng.randrange(0, 12)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(0, 3)] = ["filler"] * rng.randrange(0, 3)
            words = words or ["filler"]
        if n % 10 == 0:
            rng.shuffle(words)
        texts.append(" ".join(["start"] * rng.randrange(0, 5) + words * rng.randrange(1, 3)))

    def plain(text):
        words, labels = text.split(), set()
        grams = [tuple(words[i : i + gram]) for i in range(len(words) - gram + 1)]
        for t in known:
            own = [t.words[i : i + gram] for i in range(t.grams)]
            hits = [(p - q, q, p) for p, x in enumerate(grams) for q, y in enumerate(own) if x == y]
            if t.phrase:
                found = any(sum(d == e for e, _, _ in hits) == t.grams for d, _, _ in hits)
            else:
                bands = {d: [h for h in hits if d <= h[0] <= d + gap] for d in {h[0] for h in hits}}
                votes = {d: len({q for _, q, _ in b}) for d, b in bands.items() if 100 * len({q for _, q, _ in b}) >= license_scan.COVERAGE * t.grams}
                best = [d for d, v in votes.items() if (v, -d) == max((w, -e) for e, w in votes.items() if abs(e - d) <= gap)]
                inside = lambda b: set(grams[min(p for _, _, p in b) : max(p for _, _, p in b) + 1])
                found = any(100 * len(set(own) & inside(bands[d])) // len(set(own)) >= license_scan.COVERAGE for d in best)
            if found:
                labels.add(t.label)
        return ",".join(sorted(labels))

    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in rows} == {i: plain(t) for i, t in enumerate(texts)}
    assert 0 < sum(bool(r.labels) for r in rows) < len(texts)  # the texts hold both kinds


def test_license_scan_of_hard_rows(hard, empty):
    assert license_scan.scan(hard).count() == len(HARD) and license_scan.scan(empty).count() == 0


# ---- pipeline


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, now = docs.count(), docs
    for name, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        path = os.path.join(pipeline.shared_dir(spark), f"test-{name.replace(' ', '-')}-{zlib.crc32(name.encode())}-{random.random()}")
        now.write.parquet(path)
        now = spark.read.parquet(path)
        assert 0 < now.count() <= before
        before = now.count()
    texts = [r.text for r in now.collect()]
    assert len({" ".join(t.split()) for t in texts}) == len(texts)
    assert all(not brute.base_spans(t) or "[" in t for t in texts)
    packed = pipeline.STAGES[-1][1](spark, now, SF)
    assert packed.agg(F.sum("n_tokens")).first()[0] == sum(len(t.split()) for t in texts)
