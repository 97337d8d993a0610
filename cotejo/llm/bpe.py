"""BPE as an automaton: compile the merges by successive merge gadgets, encode words by transitions, decode by arc labels.

The automaton reads tokens and accepts exactly the token sequences that the merge rules produce. It starts as one state with
an arc for each base token. The gadget of a rule (a, b) -> ab acts on the state q that the a-arcs lead to, if q has a b-arc:
a clone q' of q without that arc becomes the new target of the a-arcs, and every state with an a-arc gets an ab-arc to where
q's b-arc leads. Targets so depend on the label alone, and a state is its parent, its time of creation and the arc it lost;
whether a state has an arc follows from these tables, and answers are kept as transitions. A word has one accepted path, whose
arc labels are its tokens.

Defined results: null text counts as empty and has no tokens; special tokens in a text are taken as in the vocabulary file;
very long texts are split into words first, and a very long word takes time in proportion to its length; repeated rows are
encoded one by one; an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import arrow_batches, read_table, text_of


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character, by the public byte-level rule: printable bytes stand for themselves, others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class MergeAutomaton:
    """Tables of the automaton over token ids, and the walk that finds a word's accepted path."""

    #: Transitions kept at once.
    KNOWN = 2_000_000

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.label = {i: t for t, i in vocab.items()}
        self.vocab, self.suffix = vocab, suffix
        self.born: dict[int, int] = {}  # token: time of its rule, 0 for base tokens
        self.left: dict[int, int] = {}
        self.target: dict[int, int] = {}  # token: state its arcs lead to
        self.parent, self.since, self.lost = [-1], [0], [-1]  # by state; state 0 is the start
        self.known: dict[tuple[int, int], bool] = {}
        made = {a + b for a, b in merges}
        for t, i in vocab.items():
            if t not in made:
                self.born[i], self.target[i] = 0, 0
        for time, (a, b) in enumerate(merges, 1):
            x, y, xy = vocab[a], vocab[b], vocab[a + b]
            q = self.target[x]
            if not self._has_arc(q, y):
                self.born.setdefault(xy, time), self.left.setdefault(xy, x), self.target.setdefault(xy, 0)
                continue
            onward = self.target[y]
            self.parent.append(q), self.since.append(time), self.lost.append(y)
            self.target[x] = len(self.parent) - 1
            self.born[xy], self.left[xy], self.target[xy] = time, x, onward
        # Lengths that arcs have, longest first, by their first three symbols; shorter ones are always tried.
        lengths: dict[str, set[int]] = {}
        for t in vocab:
            bare = t[: -len(suffix)] if suffix and t.endswith(suffix) else t
            lengths.setdefault(bare[:3], {1, 2}).update({len(bare)} if len(bare) > 2 else ())
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}

    def _has_arc(self, state: int, token: int) -> bool:
        while state:
            if self.born[token] >= self.since[state]:
                if self.born[token] == 0:
                    return True
                token = self.left[token]  # arcs made after the state exist where the rule's left arc does
            elif self.lost[state] == token:
                return False
            else:
                state = self.parent[state]
        return True

    def step(self, state: int, token: int) -> bool:
        key = (state, token)
        if (ok := self.known.get(key)) is None:
            if len(self.known) >= self.KNOWN:
                self.known.clear()
            ok = self.known[key] = self._has_arc(state, token)
        return ok

    def encode_word(self, symbols: str) -> list[int]:
        """Ids of one word in the byte alphabet; the word's last symbol carries the suffix. Longest arcs are tried first,
        and a (place, state) that led nowhere is not tried again."""
        n, suffix, vocab, target, known = len(symbols), self.suffix, self.vocab, self.target, self.known
        lengths, short = self.lengths, (2, 1)
        dead: set[tuple[int, int]] = set()
        path: list[tuple[int, int, int, int]] = []  # place, state, tries so far, token taken
        place, state, tried = 0, 0, 0
        while place < n:
            found = -1
            choices = lengths.get(symbols[place : place + 3], short)
            for k in range(tried, len(choices)):
                end = place + choices[k]
                if end < n:
                    token = vocab.get(symbols[place:end])
                elif end == n:
                    token = vocab.get(symbols[place:] + suffix)
                else:
                    continue
                if token is not None and token in target:
                    ok = known.get((state, token))
                    if (self.step(state, token) if ok is None else ok) and not (dead and (end, target[token]) in dead):
                        found, tried = token, k + 1
                        break
            if found >= 0:
                path.append((place, state, tried, found))
                place, state, tried = end, target[found], 0
            else:
                dead.add((place, state))
                if not path:
                    raise ValueError(f"no accepted path for {symbols!r}")
                place, state, tried, _ = path.pop()
        return [p[3] for p in path]

    def emit(self, ids: list[int]) -> str:
        """The arc labels of a path."""
        return "".join(self.label[i] for i in ids)


class WordTokenizer:
    """Reads a vocabulary file of the word-end kind: normaliser, word pattern, merges and special tokens."""

    CACHED = 400_000

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        model = spec["model"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.label | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.between = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes = byte_alphabet()
        self.cache: dict[str, tuple[int, ...]] = {}

    def normal(self, text: str) -> str:
        """NFC and lower case, character by character: a final sigma is an ordinary one."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def word(self, word: str) -> tuple[int, ...]:
        if len(self.cache) >= self.CACHED:
            self.cache.clear()
        ids = self.cache[word] = tuple(self.automaton.encode_word("".join(map(self.bytes.__getitem__, word.encode()))))
        return ids

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is a special token, its content or a word of the normal text)."""
        start = 0
        if self.between is not None and any(s in text for s in self.special):
            for m in self.between.finditer(text):
                yield from ((False, w) for w in self.words(self.normal(text[start : m.start()])))
                yield True, m[0]
                start = m.end()
        yield from ((False, w) for w in self.words(self.normal(text[start:])))

    def encode(self, text: str) -> list[int]:
        get, out = self.cache.get, []
        for special, piece in self.pieces(text):
            if special:
                out.append(self.special[piece])
            else:
                out.extend(get(piece) or self.word(piece))
        return out

    def decode(self, ids: list[int]) -> str:
        """Arc labels joined by spaces, as the library does for a file without a decoder."""
        return " ".join(map(self.labels.__getitem__, ids))


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_LOADED: dict[str, WordTokenizer] = {}


def loaded(file_text: str) -> WordTokenizer:
    """One compiled automaton a worker process."""
    key = hashlib.sha256(file_text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordTokenizer(file_text)
    return _LOADED[key]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: id_col (long), ids (array<int>), decoded (string). vocabulary: path of the file on the driver, whose text, of
    fixed size, is broadcast."""
    spark = docs.sparkSession
    arrow_batches(spark, 1000)
    shared = spark.sparkContext.broadcast(vocabulary_text(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(shared.value)
        for batch in batches:
            ids = [t.encode(x) for x in batch.column(1).to_pylist()]
            decoded = [t.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long"), text_of(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: id_col, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, without sending ids back."""
    spark = docs.sparkSession
    arrow_batches(spark, 1000)
    shared = spark.sparkContext.broadcast(vocabulary_text(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(shared.value)
        for batch in batches:
            rows = [t.encode(x) for x in batch.column(1).to_pylist()]
            numbers = [hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() for ids in rows]
            labels = [hashlib.sha256(t.decode(ids).encode()).hexdigest() for ids in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.fromiter(map(len, rows), np.int64, len(rows))), pa.array(numbers, pa.string()), pa.array(labels, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long"), text_of(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
