"""Retrieval over long documents: split into fragments, score fragments for a question's terms, pick within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARS, TITLE_WEIGHT = 1800, 3.0


def split_documents(docs: DataFrame, id_col: str, text_col: str, most: int = MOST_CHARS) -> DataFrame:
    """(id_col, part, title, text): paragraphs, each cut at line breaks into pieces of at most `most` characters.

    A paragraph's title is its first line. Pieces are formed by array functions: a piece ends at the last line break in its
    second half, else at `most` characters.
    """
    paragraphs = docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"\n\s*\n|\f")).alias("_p", "_t"))
    paragraphs = paragraphs.withColumn("_t", F.trim(F.regexp_replace("_t", r"^\s+|\s+$", ""))).filter("_t <> ''")
    last = f"{most} - instr(reverse(substring(a.rest, 1, {most})), '\n')"
    cut = f"if(instr(substring(a.rest, 1, {most}), '\n') > 0 AND {last} > {most} div 2, {last}, {most})"
    step = f"if(length(a.rest) <= {most}, a, named_struct('rest', regexp_replace(substring(a.rest, {cut} + 1), '^\\\\s+|\\\\s+$', ''), 'out', concat(a.out, array(substring(a.rest, 1, {cut})))))"
    pieces = f"aggregate(sequence(0, length(_t) div ({most} div 2)), named_struct('rest', _t, 'out', cast(array() AS array<string>)), (a, i) -> {step}, a -> filter(concat(a.out, array(a.rest)), x -> x <> ''))"
    exploded = paragraphs.select(id_col, "_p", F.substring_index("_t", "\n", 1).substr(1, 80).alias("title"), F.posexplode(F.expr(pieces)).alias("part", "text"))
    return exploded.select(id_col, F.col("_p").alias("paragraph"), "part", "title", "text")


def lexical_scores(fragments: DataFrame, key: list[str], text_col: str, terms: list[str], title_col: str | None = None, title_weight: float = TITLE_WEIGHT) -> DataFrame:
    """(key, score) of fragments with a positive score: sum of idf * tf / (tf + 1.5), more for terms of the title. Words are
    counted per fragment by array functions, so only the asked terms are ever shuffled."""
    asked = [t for t in dict.fromkeys(terms)]
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    with_words = fragments.select(*key, words(F.col(text_col)).alias("_w"), (words(F.col(title_col)) if title_col else F.array().cast("array<string>")).alias("_h"))
    counts = with_words.select(*key, *[F.expr(f"size(filter(_w, w -> w = '{t}'))").alias(f"_n{i}") for i, t in enumerate(asked)], *[F.array_contains("_h", t).alias(f"_i{i}") for i, t in enumerate(asked)])
    stats = fragments_stats(counts, asked)
    score = F.lit(0.0)
    for i, t in enumerate(asked):
        n = F.col(f"_n{i}")
        idf = F.log(1 + F.lit(float(stats[0])) / (1 + F.lit(float(stats[1][i]))))
        score = score + F.when(n > 0, idf * n / (n + 1.5) * F.when(F.col(f"_i{i}"), F.lit(title_weight)).otherwise(1.0)).otherwise(0.0)
    return counts.select(*key, score.alias("score")).filter("score > 0")


def fragments_stats(counts: DataFrame, asked: list[str]) -> tuple[int, list[int]]:
    """Number of fragments, and of those that hold each asked term: one row."""
    row = counts.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"_n{i}") > 0).alias(f"d{i}") for i in range(len(asked))]).first()
    return max(1, row.n), [row[f"d{i}"] for i in range(len(asked))]


def pick_within(scored: list[tuple[int, float, int]], budget: int) -> list[int]:
    """Indexes, best score first, whose sizes fit the budget together; the best is always taken."""
    chosen, used = [], 0
    for index, score, size in sorted(scored, key=lambda x: (-x[1], x[0])):
        if score <= 0 or (chosen and used + size > budget):
            continue
        chosen.append(index)
        used += size
        if used >= budget:
            break
    return sorted(chosen)
