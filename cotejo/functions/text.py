"""Cleaning of untyped text cells: trimming, key normal forms, locale-tolerant numbers.

All are JVM-side Column expressions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that mean "nothing here" once trimmed and lower-cased.
EMPTY_WORDS = ("nan", "none", "<na>")
KEY_FORMS = ("exact", "digits", "no_zeros", "folded")
KEY_SEPARATOR = "|"
#: What a number may look like before it is cast; the cast alone would take "12d", "inf" and "NaN".
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
AMOUNT = "decimal(28,6)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: White space of any script, as a list for trimming; the file separators U+001C to U+001F count.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column | str) -> Column:
    """Without white space of any script at the ends."""
    return F.trim(_col(c).cast("string"), F.lit(WHITE))


def clean(c: Column | str) -> Column:
    """Trimmed text; null and words for nothing become ""."""
    words = "|".join(EMPTY_WORDS)
    return F.regexp_replace(F.coalesce(strip(c), F.lit("")), rf"(?i)\A(?:{words})\z", "")


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def without_zeros(t: Column) -> Column:
    """Without leading zeros; only zeros leave one."""
    return F.regexp_replace(t, r"(?s)\A0+(?=.)", "")


@cache
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form has one ASCII character, those characters, and the longer forms, from the Unicode data."""
    short, long = [], {}
    for point in [*range(0x80, 0xD800), *range(0xF900, 0x20000)]:
        c = chr(point)
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            short.append((c, plain))
        elif plain:
            long[c] = plain
    return "".join(p[0] for p in short), "".join(p[1] for p in short), long


def fold(t: Column) -> Column:
    """ASCII upper case without accents and white space, by compatibility forms. Texts with characters of longer forms (ligatures,
    fractions) are few; only they are spelled out character by character."""
    one, plain, long = _fold_tables()
    short = F.translate(t, one, plain)
    forms = F.create_map(*[F.lit(x) for pair in long.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(short, ""), lambda c: F.coalesce(forms[c], c)), "")
    ascii_text = F.regexp_replace(F.when(short.rlike(r"[^\x00-\x7F]"), spelled).otherwise(short), r"[^\x00-\x7F]", "")
    return F.regexp_replace(F.upper(ascii_text), r"\s+", "")


def key_form(c: Column | str, form: str) -> Column:
    """A key part in one of KEY_FORMS; never null."""
    t = clean(c)
    if form == "digits":
        return without_zeros(F.regexp_replace(t, r"[^0-9]", ""))
    if form == "no_zeros":
        return without_zeros(t)
    if form == "folded":
        return fold(t)
    if form == "exact":
        return t
    raise ValueError(f"unknown key form {form!r}")


def composite_key(columns: list[str], form: str, present: list[str]) -> Column:
    """Parts joined by "|"; a column that is not there is an empty part."""
    return F.concat_ws(KEY_SEPARATOR, *[key_form(c, form) if c in present else F.lit("") for c in columns])


def pair_key(columns: list[str]) -> Column:
    """Key of the two-table comparison: parts without leading zeros; a missing value is an empty part, a blank one is 0."""
    parts = [F.when(F.col(c).isNull() | F.col(c).cast("string").isin("None", "nan"), F.lit("")).otherwise(F.regexp_replace(F.regexp_replace(strip(c), "^0+", ""), "^$", "0")) for c in columns]
    return F.concat_ws(KEY_SEPARATOR, *parts)


#: One grammar of numbers for cells and for values that the user gives. White space and "$" count for nothing, a currency may
#: stand before the digits, and the last of comma and point is the decimal mark: marks of the other kind before it are dropped.
_EXPONENT = r"(?:[eE][+-]?[0-9]+)?"
_ANY_CURRENCY = r"^([+-]?)[A-Za-z€]{1,3}(?=[0-9+-])"
_KNOWN_CURRENCY = r"^([+-]?)(?:R|US|U|€|EUR|USD|BRL|ARS)(?=[0-9+-])"
_GROUP_MARKS = rf"\.(?=[0-9.]{{0,400}},[0-9]*{_EXPONENT}$)|,(?=[0-9,]{{0,400}}\.[0-9]*{_EXPONENT}$)"


def _number_text(c: Column | str, currency: bool, strict: bool) -> Column:
    """The number as a plain text, or "" or null. Every step names its input once, so plans stay short; plain numbers, the
    most frequent cells, take the first branch."""
    raw = _col(c).cast("string")
    t = F.regexp_replace(raw, r"(?U)[\s$]" if currency else r"(?U)\s", "")
    if currency:
        t = F.regexp_replace(t, _KNOWN_CURRENCY if strict else _ANY_CURRENCY, "$1")
    t = F.translate(F.regexp_replace(t, _GROUP_MARKS, ""), ",", ".")
    return F.when(raw.rlike(PLAIN_NUMBER), raw).otherwise(F.regexp_extract(t, PLAIN_NUMBER, 0))


def number_of(text: str) -> float | None:
    """The number that a cell of this text holds, on the driver."""
    t = re.sub(_ANY_CURRENCY, r"\1", "".join(c for c in str(text) if c != "$" and not c.isspace()))
    t = re.sub(_GROUP_MARKS, "", t).replace(",", ".")
    return float(t) if re.search(PLAIN_NUMBER, t) else None


def parse_number(c: Column | str, currency: bool = True, strict: bool = False) -> Column:
    """Double from `1.234,56`, `1,234.56`, `12,5`, `$ 100`, `R$ 1.234,56`; null if it is no number.

    One to three letters before a digit count as a currency, so `A1` is 1; strict takes known currencies only.
    """
    return _number_text(c, currency, strict).try_cast("double")


def parse_amount(c: Column | str, currency: bool = True, strict: bool = False) -> Column:
    """The same as an exact decimal of six places, whose sums do not depend on the order of rows."""
    return _number_text(c, currency, strict).try_cast(AMOUNT)


def format_number(x: Column | str) -> Column:
    """Six decimals without trailing zeros; null is ""."""
    shown = F.regexp_replace(F.format_string("%.6f", _col(x).cast("double")), r"\.?0+$", "")
    return F.when(_col(x).isNull(), F.lit("")).otherwise(shown)


def fold_name(name: str) -> str:
    """A column name as ASCII letters and digits in lower case."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return "".join(c for c in plain if c.isalnum())


def snake_name(name: str) -> str:
    """A column name as lower-case words joined by underscores."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return "_".join("".join(c if c.isalnum() else " " for c in plain).split()) or "column"


def free_name(name: str, taken: list[str]) -> str:
    """name, or `name (2)`, `name (3)` and so on: the first that is not taken."""
    chosen, n = name, 2
    while chosen in taken:
        chosen, n = f"{name} ({n})", n + 1
    return chosen
