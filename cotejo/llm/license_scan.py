"""License scan by diagonal voting, DataFrame operations only.

Every word k-gram of every text is joined to the places where licence templates hold it. A hit votes for the diagonal
(place in the text - place in the template). Votes are gathered by (document, template, diagonal), partly before the shuffle,
so a document's misses collapse into one row. Diagonals of one template that lie at most MERGE_GAP apart in all, as inserted or
dropped words make them, are merged into a band; so a band's words stand within the template's length plus MERGE_GAP. A band
counts by the distinct template places that voted, however often they did. Its span is then verified: the words of the text
are cut out and the template's k-grams counted among theirs; the share found is the span's cover. A phrase is the special case
of one diagonal on which every k-gram votes, which is a consecutive occurrence.

Defined results: null or empty text has no words and no labels; ties between templates are all reported, in sorted order; of
overlapping bands of a template the one of greatest cover, then of least diagonal, is its span; repeated rows are scanned one
by one; very long texts have more k-grams and nothing else; an empty table gives an empty result; columns other than the named
ones are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cotejo.llm.common import fresh, lower_ascii, numbered, read_table, small_side, stage_table, text_of

GRAM = 3
#: Words apart that two diagonals of one licence text may lie, and the percentage of its k-grams that must have voted.
MERGE_GAP, COVERAGE = 12, 60

#: Fixed values of the contract.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Openings of common licence texts, and texts or notices as a whole.
TEXTS = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-text"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-text"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-text"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages "
        "or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit-whole",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever "
        "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
        "isc-whole",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
        "code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by "
        "the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
        "for a particular purpose are disclaimed",
        "bsd-2-whole",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of "
        "any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2-notice",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a "
        "particular purpose see the gnu general public license for more details",
        "gpl-notice",
    ),
)

#: Fixed value of the contract: what is not part of a word.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    phrase: bool

    @property
    def grams(self) -> int:
        return len(self.words) - GRAM + 1


def templates() -> list[Template]:
    made = [Template(tuple(p.split()), label, True) for p, label in PHRASES] + [Template(tuple(t.split()), label, False) for t, label in TEXTS]
    assert all(t.grams >= 1 for t in made)
    return made


def _gram_hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _template_places(spark: SparkSession, known: list[Template]) -> DataFrame:
    """(_gram, _g0 ... _g2, template, t_place): a row for each k-gram of each template; their number is fixed by the list."""
    rows = [(n, i, *t.words[i : i + GRAM]) for n, t in enumerate(known) for i in range(t.grams)]
    at = spark.createDataFrame(rows, "template int, t_place int, " + ", ".join(f"_g{i} string" for i in range(GRAM)))
    return at.withColumn("_gram", _gram_hash([F.col(f"_g{i}") for i in range(GRAM)]))


def _words(text_col: str) -> Column:
    return F.array_remove(F.split(lower_ascii(text_of(text_col)), NOT_WORD), "")


def diagonal_votes(rows: DataFrame, at: str, id_col: str, text_col: str, known: list[Template]) -> DataFrame:
    """(_row, _id, n_words, template, diagonal, places, first), rows having numbers in column `at`: one row for each diagonal that got
    votes, with the template places that voted, and one with null template for each row."""
    grams = ", ".join(f"w[i + {j}]" for j in range(GRAM))
    # The words are bound to w, or the optimizer would split the text anew for each word. The k-gram at -1 is nobody's: it
    # keeps documents without any other.
    rolled = f"concat(array(struct(-1 AS p, 0L AS h)), if(size(w) >= {GRAM}, transform(sequence(0, size(w) - {GRAM}), i -> struct(i AS p, xxhash64({grams}) AS h)), array()))"
    rolled = (
        rows.select(F.col(at).alias("_row"), F.col(id_col).alias("_id"), _words(text_col).alias("_words"))
        .select("_row", "_id", F.expr(f"inline(transform(array(_words), w -> struct(cast(size(w) AS bigint) AS n_words, {rolled} AS _at)))"))
        .select("_row", "_id", "n_words", F.inline("_at").alias("_place", "_gram"))
    )
    places = _template_places(rows.sparkSession, known).select("_gram", "template", "t_place")
    hits = rolled.join(F.broadcast(places), "_gram", "left")
    voted = hits.groupBy("_row", "_id", "n_words", "template", (F.col("_place") - F.col("t_place")).alias("diagonal"))
    return voted.agg(F.collect_set("t_place").alias("places"), F.min("_place").alias("first"), F.max("_place").alias("last"))


def _about(spark: SparkSession, known: list[Template], *columns: str | Column) -> DataFrame:
    """(template, columns) of the templates, a table of fixed size: grams (number), phrase, label, kinds (the distinct k-grams)."""
    rows = [(n, t.grams, t.phrase, t.label, sorted({" ".join(t.words[i : i + GRAM]) for i in range(t.grams)})) for n, t in enumerate(known)]
    return F.broadcast(spark.createDataFrame(rows, "template int, grams int, phrase boolean, label string, kinds array<string>").select("template", *columns))


def candidate_spans(votes: DataFrame, known: list[Template]) -> DataFrame:
    """(_row, template, phrase, start, end): bands with votes enough, of overlapping ones the best; word places, end exclusive."""
    on = votes.filter("template IS NOT NULL").join(_about(votes.sparkSession, known, "grams", "phrase"), "template")
    by_diagonal = Window.partitionBy("_row", "template").orderBy("diagonal")
    band, around = by_diagonal.rangeBetween(0, MERGE_GAP), by_diagonal.rangeBetween(-MERGE_GAP, MERGE_GAP)
    whole = on.filter("phrase AND size(places) = grams").select("_row", "template", "phrase", F.col("first").alias("start"), (F.col("last") + GRAM).alias("end"))
    merged = (
        on.filter("NOT phrase")
        .withColumn("start", F.min("first").over(band))
        .withColumn("end", F.max("last").over(band) + GRAM)
        .withColumn("_votes", F.size(F.array_distinct(F.flatten(F.collect_list("places").over(band)))))
        .filter(100 * F.col("_votes") >= COVERAGE * F.col("grams"))
    )
    rank = F.struct("_votes", -F.col("diagonal"))
    best = merged.withColumn("_best", F.max(rank).over(around)).filter(F.col("_best") == rank)
    return whole.unionByName(best.select("_row", "template", "phrase", "start", "end"))


def verified_spans(rows: DataFrame, at: str, text_col: str, candidates: DataFrame, known: list[Template]) -> DataFrame:
    """candidates, with cover (percent): the share of the template's k-grams that the words of the span hold, as words."""
    by_row = stage_table(candidates.groupBy("_row").agg(F.collect_list(F.struct("template", "phrase", "start", "end")).alias("_found")), "candidates")
    held = rows.select(F.col(at).alias("_row"), F.col(text_col).alias("_raw")).join(small_side(by_row), "_row")
    one = held.select("_row", _words("_raw").alias("_words"), "_found").select("_row", "_words", F.inline("_found")).join(_about(rows.sparkSession, known, "kinds"), "template")
    rolled = F.expr(f"transform(sequence(start, end - {GRAM}), i -> concat_ws(' ', slice(_words, int(i) + 1, {GRAM})))")
    share = F.size(F.array_intersect("kinds", rolled)) * 100 / F.size("kinds")
    need = F.when(F.col("phrase"), F.lit(100)).otherwise(F.lit(COVERAGE))
    return one.withColumn("cover", F.floor(share)).filter(F.col("cover") >= need).select("_row", "template", "phrase", "start", "end", "cover")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[Template] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, found). documents: _row, id_col, n_words of each row of docs; found: the verified spans by _row."""
    known = templates() if known is None else known
    at = fresh(docs, "_row")
    rows = numbered(docs, at)
    # Stored, or the filters below would be pushed into two scans of the texts.
    votes = stage_table(diagonal_votes(rows, at, id_col, text_col, known), "votes")
    found = verified_spans(rows, at, text_col, candidate_spans(votes, known), known)
    return votes.filter("template IS NULL").select("_row", F.col("_id").alias(id_col), "n_words"), found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[Template] | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    known = templates() if known is None else known
    documents, found = spans(docs, id_col, text_col, known)
    best = (
        found.join(_about(docs.sparkSession, known, F.col("label").alias("_label")), "template")
        .groupBy("_row")
        .agg(
            F.count(F.when(F.col("phrase"), 1)).alias("n_base"),
            F.min(F.when(F.col("phrase"), F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("phrase"), F.col("start"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("_label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("_label")), ",").alias("labels"),
            (F.max("cover") / 100).alias("score"),
        )
    )
    return documents.join(best, "_row", "left").select(
        id_col,
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def _values() -> str:
    known = templates()
    return ", ".join(f"({n}, {i}, '{' '.join(t.words[i : i + GRAM])}', {t.grams}, {len({t.words[j : j + GRAM] for j in range(t.grams)})}, '{t.label}', {str(t.phrase).upper()})" for n, t in enumerate(known) for i in range(t.grams))


OP10_SQL = rf"""
WITH tp(template, t_place, gram, grams, kinds, label, phrase) AS (VALUES {_values()}),
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '{re.sub(r"x00", "x{0}", NOT_WORD)}'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS place, array_to_string(w[i:i + {GRAM - 1}], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {GRAM - 2})) AS i FROM w)),
v AS (SELECT doc_id, template, grams, kinds, label, phrase, place - t_place AS diagonal, list(t_place) AS places, min(place) AS first, max(place) AS last
      FROM g JOIN tp USING (gram) GROUP BY ALL),
b AS (SELECT doc_id, template, grams, kinds, label, phrase, diagonal, len(list_distinct(flatten(list(places) OVER r))) AS got, min(first) OVER r AS s, max(last) OVER r + {GRAM} AS e
      FROM v WHERE NOT phrase WINDOW r AS (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {MERGE_GAP} FOLLOWING)),
t AS (SELECT *, max(struct_pack(a := got, b := -diagonal)) OVER n AS best FROM b WHERE 100 * got >= {COVERAGE} * grams
      WINDOW n AS (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN {MERGE_GAP} PRECEDING AND {MERGE_GAP} FOLLOWING)),
c AS (SELECT doc_id, t.template, t.kinds, t.label, t.diagonal, count(DISTINCT gram) AS words FROM t JOIN g USING (doc_id) JOIN tp USING (gram)
      WHERE tp.template = t.template AND place >= s AND place <= e - {GRAM} AND best.a = got AND best.b = -diagonal GROUP BY ALL),
k AS (SELECT doc_id, label, FALSE AS phrase, 0 AS start, 100 * words // kinds AS cover FROM c WHERE 100 * words // kinds >= {COVERAGE}
      UNION ALL SELECT doc_id, label, TRUE, first, 100 FROM v WHERE phrase AND len(places) = grams),
r AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
        max(cover) / 100 AS score FROM k GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN r USING (doc_id)
"""
