"""Quality rules: a threshold table compiled into one projection, DataFrame functions only.

Each rule bounds a ratio of two integer measures in percent, so a verdict never depends on floating point. The measures
are array and string functions of the row alone: the plan is a scan and projections, without a shuffle.

Defined results: null or empty text has no words, fails `n_words < 10` and is not kept; a rule with denominator 0 passes;
a null lang takes no stop-word rule, as any language without a list; very long texts cost O(n log n); repeated rows are
judged one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import SPACE_CLASS, read_table, text_of

#: Frequent function words by language code.
STOP_WORDS = {
    "en": "the of and to in a is that for it as with be on are by this or an from at not".split(),
    "de": "der die und in den von zu das mit sich des auf ein dem nicht ist im eine als auch".split(),
    "fr": "de la le les et des en un du une que est pour qui dans par au sur pas elle".split(),
    "es": "de la que el en y los del se las por un para con no una su al lo como".split(),
}


@dataclass(frozen=True)
class Rule:
    """low <= 100 * over / under <= high, both in percent; None: no bound on that side."""

    name: str
    over: str
    under: str
    low: int | None = None
    high: int | None = None

    def passes(self) -> str:
        bounds = [f"100 * {self.over} >= {self.low} * {self.under}"] * (self.low is not None)
        bounds += [f"100 * {self.over} <= {self.high} * {self.under}"] * (self.high is not None)
        return f"({self.under} = 0 OR ({' AND '.join(bounds)}))"


RULES = (
    Rule("word length", "word_chars", "n_words", 200, 1500),
    Rule("symbols to characters", "n_symbols", "word_chars", None, 10),
    Rule("symbols to words", "n_symbols", "n_words", None, 40),
    Rule("stop words", "n_stop_words", "n_stop_base", 2, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 60),
)


def measures(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", stop_words: dict[str, list[str]] = STOP_WORDS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_stop_base (long)."""
    windows = "transform(sequence(0, size(_words) - 5), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4]))"
    # Equal windows have equal hashes, so texts of distinct hashes have no repeat; only the others sort the windows themselves.
    named = "sort_array(transform(sequence(0, size(_words) - 5), i -> struct(array_join(slice(_words, i + 1, 5), ' ') AS k, i AS p)))"
    last = "size(_named) - 1"
    places = f"filter(transform(sequence(0, {last}), j -> if((j > 0 AND _named[j].k = _named[greatest(j - 1, 0)].k) OR (j < {last} AND _named[j].k = _named[least(j + 1, {last})].k), _named[j].p, -1)), p -> p >= 0)"
    covered = "aggregate(sequence(0, size(_places) - 1), 0, (a, j) -> a + if(j = size(_places) - 1, 5, least(5, _places[least(j + 1, size(_places) - 1)] - _places[j])))"
    stop = F.lit(0)
    for lang, words in stop_words.items():
        listed = ", ".join(f"'{w}'" for w in words)
        hits = F.expr(f"size(filter(_words, w -> lower(w) IN ({listed})))")
        stop = F.when(F.col("_lang") == lang, hits).otherwise(stop)
    return (
        docs.withColumn("_text", text_of(text_col))
        .withColumn("_lang", F.col(lang_col).cast("string"))
        .withColumn("_words", F.array_remove(F.split("_text", SPACE_CLASS), ""))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("_windows", F.expr(f"if(size(_words) >= 5, {windows}, array())"))
        .withColumn("_named", F.expr(f"if(size(array_distinct(_windows)) < size(_windows), {named}, NULL)"))
        .withColumn("_places", F.expr(f"if(_named IS NOT NULL, sort_array({places}), NULL)"))
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint"))
        .withColumn("n_symbols", F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("bigint"))
        .withColumn("n_lines", F.size("_lines").cast("bigint"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
        .withColumn("n_repeat_words", F.expr(f"if(_places IS NOT NULL, {covered}, 0)").cast("bigint"))
        .withColumn("n_stop_words", stop.cast("bigint"))
        .withColumn("n_stop_base", F.when(F.col("_lang").isin(list(stop_words)), F.size("_words")).otherwise(0).cast("bigint"))
        .drop("_text", "_lang", "_words", "_lines", "_windows", "_named", "_places")
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression over the measures."""
    return F.expr(" AND ".join(r.passes() for r in rules))


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row breaks, in table order."""
    return F.expr("filter(array(" + ", ".join(f"if({r.passes()}, NULL, '{r.name}')" for r in rules) + "), x -> x IS NOT NULL)")


BASE_FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return measures(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.expr(BASE_FAILED).alias("base_failed"),
        (~F.expr(BASE_FAILED) & verdict()).alias("kept"),
        "n_lines",
        "n_stop_words",
    )


def _sql_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM dup, range(5) r(o) GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         (CASE lang {" ".join(f"WHEN '{k}' THEN len(list_filter(w, lambda x: lower(x) IN ({_sql_list(v)})))" for k, v in STOP_WORDS.items())} ELSE 0 END)::BIGINT AS n_stop_words,
         (CASE WHEN lang IN ({_sql_list(list(STOP_WORDS))}) THEN len(w) ELSE 0 END)::BIGINT AS n_stop_base
  FROM d),
r AS (
  SELECT m.*, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed,
       NOT {BASE_FAILED} AND {" AND ".join(x.passes() for x in RULES)} AS kept, n_lines, n_stop_words FROM r
"""
