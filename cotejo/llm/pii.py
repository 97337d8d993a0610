"""Personal data: exact base spans, and information-theoretic sanitisation of terms, DataFrame operations only.

Base spans are e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers. They are the protected entities. A
term discloses an entity as far as seeing the term tells that the entity is there: the pointwise mutual information
PMI(e, t) = log2(N n(e, t) / (n(e) n(t))) as a share of the entity's information content IC(e) = log2(N / n(e)), where n counts
documents, n(t) all documents that hold the term, n(e, t) those that hold both, wherever in the text. A term at share GENERALISE
or more is replaced by its kind of word, at share REMOVE or more it is removed, in all its places in all documents, also those
that do not print the entity; the greatest share over the entities counts. A term needs SUPPORT documents with the entity, since
fewer are no estimate, so terms are not judged by entities of fewer documents. Words that overlap a base span go with it.

Counts cover all documents. Pairs are formed between the entities of a document and its distinct words outside of spans, for
entities of SUPPORT documents at least, and counted with partial aggregates, so hot entities and terms are no task's burden.
n(t) is asked only for pairs that could still reach GENERALISE with the n(t) of documents with entities, which is no loss.

Defined results: null or empty text has no spans; repeated rows are counted and returned one by one; very long texts and long
runs of digits or labels are matched by loops over character classes, without recursion; an empty table gives an empty result;
columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import fresh, numbered, read_table, stage_table, text_of

#: Fixed values of the contract, in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")

SUPPORT, GENERALISE, REMOVE = 2, 0.8, 0.98
BROADCAST_TERMS = 500_000
BROADCAST_CUTS = 1_000_000

#: Stand-ins, one character each, for separators inside a match, so that a match is one character class. A text's own
#: \x01 to \x03 become \x04 first; none of the patterns can hold them.
_SEP, _DOT = "\u0001", "\u0003"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of the leftmost non-overlapping matches: gaps and matches alternate, so a match starts
    where the lengths of all gaps and matches before it end."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    return F.struct(found.alias("m"), F.transform(gaps, F.length).alias("g"))


def _placed(name: str) -> str:
    """SQL over a struct of _matches: array of (start, value)."""
    step = f"struct(a.at + {name}.g[a.i] + length(x) AS at, a.i + 1 AS i, concat(a.out, array(struct(a.at + {name}.g[a.i] AS start, x AS value))) AS out)"
    return f"aggregate({name}.m, struct(0 AS at, 0 AS i, cast(array() AS array<struct<start:int,value:string>>) AS out), (a, x) -> {step}, a -> a.out)"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: str) -> str:
    """SQL: whether the string of digits passes Luhn's test."""
    doubled = f"transform(split(reverse({digits}), ''), (c, i) -> if(i % 2 = 1, if(2 * int(c) > 9, 2 * int(c) - 9, 2 * int(c)), int(c)))"
    return f"aggregate({doubled}, 0, (a, v) -> a + v) % 10 = 0"


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _text and _spans: array<struct<start, rank, kind, end, value>>, sorted. value is the entity's normal form."""
    none = "cast(NULL AS struct<m:array<string>,g:array<int>>)"
    d = docs.withColumn("_text", text_of(text_col))
    clean = F.translate("_text", "\u0001\u0002\u0003", "\u0004\u0004\u0004")
    dots = F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    gaps = F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", _SEP)
    local = rf"[A-Za-z0-9._%+{_DOT}-]"
    email = rf"(?:\G|(?<!{local})){local}++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++"
    ip = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
    card = rf"[0-9][0-9{_SEP}]*+"
    phone = r"\+[0-9][\x20().0-9-]+[0-9]"
    d = (
        d.withColumn("_email", F.when(F.col("_text").contains("@"), _matches(dots, email)).otherwise(F.expr(none)))
        .withColumn("_ip", F.when(F.col("_text").rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _matches(F.col("_text"), ip)).otherwise(F.expr(none)))
        .withColumn("_card", F.when(F.col("_text").rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _matches(gaps, card)).otherwise(F.expr(none)))
        .withColumn("_phone", F.when(F.col("_text").contains("+"), _matches(F.col("_text"), phone)).otherwise(F.expr(none)))
    )
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    octets = "forall(split(x.value, '[.]'), o -> length(ltrim('0', o)) < 3 OR (length(ltrim('0', o)) = 3 AND ltrim('0', o) <= '255'))"
    tests = {
        "email": ("true", f"lower(translate(x.value, '{_DOT}', '.'))"),
        "ip": (octets, "x.value"),
        "card": (f"length({digits}) BETWEEN 12 AND 19 AND {_luhn(digits)}", digits),
        "phone": (f"length({digits}) BETWEEN 9 AND 15", f"concat('+', {digits})"),
    }
    lists = []
    for rank, kind in enumerate(KINDS):
        test, value = tests[kind]
        d = d.withColumn(f"_at_{kind}", F.expr(f"if(_{kind} IS NULL, NULL, {_placed(f'_{kind}')})"))
        lists.append(
            f"coalesce(transform(filter(_at_{kind}, x -> {test}), x -> struct(x.start AS start, {rank} AS rank, '{kind}' AS kind, x.start + length(x.value) AS end, {value} AS value)),"
            " cast(array() AS array<struct<start:int,rank:int,kind:string,end:int,value:string>>))"
        )
    d = d.withColumn("_spans", F.expr(f"sort_array(concat({', '.join(lists)}))"))
    return d.drop(*[f"_{k}" for k in KINDS], *[f"_at_{k}" for k in KINDS])


#: Words whose disclosure is judged: letters and digits of any script.
_TERM = r"[\p{L}\p{N}]+"


#: Stand-in for a base span, of the words' own class, so that what touches a span is one word with it.
_HIDDEN = "\u0006"


def _words(text: Column) -> Column:
    """The distinct words of text in lower case, and perhaps an empty one."""
    return F.array_distinct(F.transform(F.split(text, rf"[^\p{{L}}\p{{N}}{_HIDDEN}]+"), F.lower))


def _outside() -> str:
    """SQL: _text with each of _spans, sorted, replaced by the stand-in; of overlapping ones the rest as well."""
    text = f"translate(_text, '{_HIDDEN}', ' ')"
    step = f"struct(greatest(a.at, s.end) AS at, concat(a.out, array(if(s.start > a.at, substring({text}, a.at + 1, s.start - a.at), ''), '{_HIDDEN}')) AS out)"
    return f"aggregate(_spans, struct(0 AS at, cast(array() AS array<string>) AS out), (a, s) -> {step}, a -> concat(array_join(a.out, ''), substring({text}, a.at + 1)))"


#: Put around the words that _places picks out.
_MARK = "\u0007"


def _places() -> str:
    """SQL: the words of _text that _telling (term to share) holds and no span overlaps: array<struct<start, end, share>>.

    Those words are marked and the text is cut at the marks, so the accumulator goes over the picked words and not over all.
    """
    text = f"translate(_text, '{_MARK}', ' ')"
    words = f"regexp_extract_all({text}, '({_TERM})', 1)".replace("\\", "\\\\")
    gaps = f"split({text}, '{_TERM}', -1)".replace("\\", "\\\\")
    marked = f"zip_with({gaps}, {words}, (g, w) -> concat(g, if(w IS NULL, '', if(_telling[lower(w)] IS NULL, w, concat('{_MARK}', w, '{_MARK}')))))"
    end = "a.at + length(w)"
    free = f"(_spans IS NULL OR NOT exists(_spans, s -> a.at < s.end AND s.start < {end}))"
    out = f"if(a.i % 2 = 1 AND {free}, concat(a.out, array(struct(a.at AS start, {end} AS end, _telling[lower(w)] AS share))), a.out)"
    zero = "struct(0 AS at, 0 AS i, cast(array() AS array<struct<start:int,end:int,share:double>>) AS out)"
    return f"aggregate(split(array_join({marked}, ''), '{_MARK}', -1), {zero}, (a, w) -> struct({end} AS at, a.i + 1 AS i, {out} AS out), a -> a.out)"


def _few(stored: DataFrame) -> bool:
    return stored.count() <= BROADCAST_TERMS


def disclosing_terms(docs: DataFrame, at: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(found, terms), docs having row numbers in column `at`. found: _row, _id, _spans of each row; terms: _row, _terms of the
    rows that hold disclosing terms."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_raw"), F.col(at).alias("_row"))
    spanned = base_spans(rows, "_raw").withColumn("_held", F.when(F.size("_spans") > 0, _words(F.expr(_outside()))))
    held = F.filter("_held", lambda w: (w != "") & ~w.contains(_HIDDEN))
    found = stage_table(spanned.select("_row", "_id", "_spans", held.alias("_held")), "spans")
    n_all = found.count()
    holders = found.filter("size(_spans) > 0").select(F.explode(F.array_distinct(F.expr("transform(_spans, s -> concat(s.kind, ':', s.value))"))).alias("entity"), "_held")
    entities = holders.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(F.col("n_entity").between(SUPPORT, n_all - 1))
    entities = stage_table(entities, "entities")
    pairs = holders.join(F.broadcast(entities) if _few(entities) else entities, "entity").select("entity", "n_entity", F.explode("_held").alias("term"))
    joint = pairs.groupBy("entity", "n_entity", "term").agg(F.count(F.lit(1)).alias("n_both")).filter(F.col("n_both") >= SUPPORT)

    def share(n_term: str) -> Column:
        return F.log2(F.lit(n_all) * F.col("n_both") / (F.col("n_entity") * F.col(n_term))) / F.log2(F.lit(n_all) / F.col("n_entity"))

    here = found.select(F.explode("_held").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_here")).filter(F.col("n_here") >= SUPPORT)
    joint = stage_table(joint.join(here, "term").filter(share("n_here") >= GENERALISE).drop("n_here"), "joint")
    words = rows.select("_row", F.explode(_words(text_of("_raw"))).alias("term"))
    asked = stage_table(joint.select("term").distinct(), "asked")
    # Few asked terms go to the words; beyond the bound the words are counted before they are joined.
    few = _few(asked)
    if few:
        words = stage_table(words.join(F.broadcast(asked), "term", "left_semi"), "asked-words")
    held = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    judged = joint.join(held, "term").select("term", share("n_term").alias("share")).filter(F.col("share") >= GENERALISE)
    telling = stage_table(judged.groupBy("term").agg(F.max("share").alias("share")), "disclosure")
    there = words.join(F.broadcast(telling) if few or _few(telling) else telling, "term")
    there = stage_table(there.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("_telling")), "telling")
    # The terms of each document go to its text: broadcast up to a bound on their number over all documents.
    if (there.agg(F.sum(F.size("_telling"))).first()[0] or 0) <= BROADCAST_CUTS:
        there = F.broadcast(there)
    marked = (
        rows.join(there, "_row")
        .join(found.filter("size(_spans) > 0").select("_row", "_spans"), "_row", "left")
        .withColumn("_text", text_of("_raw"))
    )
    return found.drop("_held"), marked.select("_row", F.expr(_places()).alias("_terms"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, _spans (base), _terms (array<struct<start, end, share>>, sorted)."""
    at = fresh(docs, "_row")
    found, terms = disclosing_terms(numbered(docs, at), at, id_col, text_col)
    return found.join(terms, "_row", "left").select(F.col("_id").alias(id_col), "_spans", "_terms")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with entities replaced by [KIND] and disclosing terms generalised or removed."""
    at, cuts = fresh(docs, "_row"), fresh(docs, "_cuts")
    rows = numbered(docs, at)
    found, terms = disclosing_terms(rows, at, id_col, text_col)
    changed = found.join(terms, "_row", "left").filter("size(_spans) > 0 OR size(_terms) > 0")
    # Of overlapping spans the earlier start wins, then the longer; the rest of the later one is covered by the first's end.
    listed = """
      sort_array(concat(
        transform(_spans, s -> struct(s.start AS start, -s.end AS back, concat('[', upper(s.kind), ']') AS put)),
        coalesce(transform(_terms, t -> struct(t.start AS start, -t.end AS back, if(t.share >= {remove}, '', '\u0005') AS put)),
                 cast(array() AS array<struct<start:int,back:int,put:string>>))))""".format(remove=REMOVE)
    whole = f"coalesce(cast(`{text_col}` AS string), '')"
    word = f"substring({whole}, c.start + 1, -c.back - c.start)"
    kind = f"if({word} RLIKE '^[0-9]+$', '[NUMBER]', if({word} RLIKE '^\\\\p{{Lu}}', '[NAME]', '[WORD]'))"
    step = f"if(-c.back <= a.at, a, struct(-c.back AS at, concat(a.out, array(if(c.start > a.at, substring({whole}, a.at + 1, c.start - a.at), ''), if(c.put = '\u0005', {kind}, c.put))) AS out))"
    text = f"aggregate(`{cuts}`, struct(0 AS at, cast(array() AS array<string>) AS out), (a, c) -> {step}, a -> concat(array_join(a.out, ''), substring({whole}, a.at + 1)))"
    changes = stage_table(changed.select(F.col("_row").alias(at), F.expr(listed).alias(cuts)), "cuts")
    # The cuts are broadcast up to a bound on their number over all documents, about 50 bytes each.
    if (changes.agg(F.sum(F.size(cuts))).first()[0] or 0) <= BROADCAST_CUTS:
        changes = F.broadcast(changes)
    joined = rows.join(changes, at, "left")
    return joined.withColumn(text_col, F.expr(f"if(`{cuts}` IS NULL, `{text_col}`, {text})")).select(*docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotate(read_table(spark, sf_dir, "documents"))
    shown = "transform(_spans, s -> concat(s.kind, ':', s.start, ':', s.end))"
    every = """transform(sort_array(concat(transform(_spans, s -> struct(s.start AS start, s.rank AS rank, s.kind AS kind, s.end AS end)),
      coalesce(transform(_terms, t -> struct(t.start AS start, 9 AS rank, 'term' AS kind, t.end AS end)),
               cast(array() AS array<struct<start:int,rank:int,kind:string,end:int>>)))), s -> concat(s.kind, ':', s.start, ':', s.end))"""
    return rows.select(
        "doc_id",
        *[F.expr(f"size(filter(_spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.expr(shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.expr(every), ",").alias("spans"),
        F.coalesce(F.size("_terms"), F.lit(0)).cast("long").alias("n_terms"),
    )
