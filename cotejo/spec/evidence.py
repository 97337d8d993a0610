"""Whether a manual's text supports what a layout says of it."""

from __future__ import annotations

import difflib
import re
import unicodedata

from cotejo.spec.layout import Layout

CLOSE = 0.85
#: Words by which Spanish manuals name a separator.
_SEPARATORS = (("punto y coma", ";"), ("puntos y comas", ";"), (";", ";"), ("tabulador", "\t"), ("tab", "\t"), ("pipe", "|"), ("barra vertical", "|"), ("|", "|"), ("coma", ","), (",", ","))


def plain(text: str) -> str:
    """Compatibility form in lower case, without table and heading marks, white space collapsed, quotes straight."""
    folded = unicodedata.normalize("NFKC", text).lower().translate(str.maketrans({c: " " for c in "|*_`#>"} | {"“": '"', "”": '"', "’": "'", "‘": "'"}))
    return " ".join(folded.split())


def cells_in_one_line(evidence: str, lines: list[str]) -> bool:
    """A table row cited with cells left out: the cited cells stand in order in one line."""
    cells = [c for c in map(plain, evidence.split("|")) if c]
    if len(cells) < 2:
        return False
    pattern = re.compile(".*?".join(map(re.escape, cells)))
    return any(pattern.search(line) for line in lines)


def is_supported(evidence: str, manual: str, close: float = CLOSE) -> bool:
    """Literal, as cells of a row, or close enough around the longest common block."""
    cited, whole = plain(evidence), plain(manual)
    if len(cited) < 3:
        return False
    if cited in whole or ("|" in evidence and cells_in_one_line(evidence, [plain(x) for x in manual.splitlines()])):
        return True
    block = difflib.SequenceMatcher(None, whole, cited, autojunk=False).find_longest_match()
    if block.size >= close * len(cited):
        return True
    start = max(0, block.a - block.b - 10)
    return difflib.SequenceMatcher(None, whole[start : start + len(cited) + 20], cited, autojunk=False).ratio() >= close


def closest_phrase(evidence: str, manual: str) -> str:
    """The manual's phrase or row that is most like the cited one."""
    phrases = [p.strip() for line in manual.splitlines() for p in re.split(r"(?<=[.;:])\s+", line) if len(p.strip()) > 8]
    return max(phrases, key=lambda p: difflib.SequenceMatcher(None, plain(p), plain(evidence)).ratio(), default="")


def unsupported(layout: Layout, manual: str) -> list[tuple[str, str]]:
    """(what, closest phrase) of fields and rules whose evidence the manual does not have."""
    cited = [(f"{r.code}.{f.name}", f.evidence) for r in layout.records for f in r.fields if f.evidence] + [(r.id, r.evidence) for r in layout.rules if r.evidence]
    return [(what, closest_phrase(e, manual)) for what, e in cited if not is_supported(e, manual)]


def declared_separator(manual: str) -> str | None:
    """The field separator that the manual declares."""
    m = re.search(r"campos\s+(?:\w+\s+){0,3}?(?:delimitad|separad)\w*\s+(?:por|con)\s+(?:(?:el|la|los|las|un|una)\s+)?(?:car[aá]cter(?:es)?\s+)?[\"'«]?([^.\n]{1,20})", manual, re.I)
    said = m[1].lower() if m else ""
    return next((sign for word, sign in _SEPARATORS if said.startswith(word)), None)


def looks_fragmented(text: str, share: float = 0.4) -> bool:
    """Whether extracted text falls apart into lines of one word."""
    lines = [x.split() for x in text.splitlines() if x.strip()]
    return bool(lines) and sum(len(x) == 1 for x in lines) > share * len(lines)
