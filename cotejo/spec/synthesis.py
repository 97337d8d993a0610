"""Valid synthetic record files at any size: seeded values per row, then completion by the layout's rules."""

from __future__ import annotations

import random
import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.spec.layout import Field, Layout, Record
from cotejo.spec.writers import complete

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_FILLER = re.compile(r"^(relleno|filler|reservado|blancos?|rest)(_\d+)?$")


def _draw(seed: int, salt: str, below: int) -> Column:
    """A whole number below `below`, of the row's line, the field and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("_line")), F.lit(below))


def sample_pattern(pattern: str, rng: random.Random) -> str:
    """A text that matches a simple pattern, found by growing it: classes, ranges, repeats and alternatives."""
    from re import _constants as c
    from re import _parser as p

    def one(items) -> str:
        out = ""
        for op, arg in items:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.IN:
                out += rng.choice([x for x in map(chr, range(32, 127)) if _in(x, arg)])
            elif op is c.ANY:
                out += rng.choice(_LETTERS)
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                low, high, sub = arg
                out += "".join(one(sub) for _ in range(rng.randint(low, min(int(high), low + 4))))
            elif op is c.SUBPATTERN:
                out += one(arg[-1])
            elif op is c.BRANCH:
                out += one(rng.choice(arg[1]))
            elif op is not c.AT:
                raise ValueError(f"{pattern!r} is too rich to sample")
        return out

    def _in(x: str, items) -> bool:
        negated = items[0][0] is c.NEGATE
        hit = any(
            (op is c.LITERAL and ord(x) == arg) or (op is c.RANGE and arg[0] <= ord(x) <= arg[1])
            or (op is c.CATEGORY and {c.CATEGORY_DIGIT: x.isdigit(), c.CATEGORY_WORD: x.isalnum() or x == "_", c.CATEGORY_SPACE: x.isspace()}.get(arg, False))
            for op, arg in items
        )
        return hit != negated

    for _ in range(50):
        text = one(p.parse(pattern))
        if re.fullmatch(pattern, text):
            return text
    raise ValueError(f"no text found for {pattern!r}")


def _value(f: Field, seed: int, code: str) -> Column:
    salt = f"{code}.{f.name}"
    if f.kind == "constant":
        return F.lit(f.constant)
    if f.allowed:
        made = F.element_at(F.array(*[F.lit(a.strip()) for a in f.allowed]), (_draw(seed, salt, len(f.allowed)) + 1).cast("int")).cast(f.spark_type)
    elif f.pattern:
        rng = random.Random(f"{seed}{salt}")
        pool = sorted({sample_pattern(f.pattern, rng) for _ in range(64)})
        made = F.element_at(F.array(*map(F.lit, pool)), (_draw(seed, salt, len(pool)) + 1).cast("int"))
    elif f.kind == "text":
        n = min(f.length or 12, 12)
        letters = [F.substring(F.lit(_LETTERS), (_draw(seed, f"{salt}{i}", len(_LETTERS)) + 1).cast("int"), F.lit(1)) for i in range(n)]
        made = F.substring(F.concat(*letters), F.lit(1), (_draw(seed, salt, n) + 1).cast("int"))
    elif f.kind == "date":
        made = F.date_add(F.lit(date(2025, 1, 1)), _draw(seed, salt, 365).cast("int"))
        made = made if "DD" in (f.date_mask or "").upper() else F.trunc(made, "month")
    else:
        scale = f.decimals if f.kind == "decimal" else 0
        digits = max(1, min((f.length or 10) - scale - 4, 6)) + scale
        made = ((_draw(seed, salt, 10**digits - 1) + 1).cast("decimal(38,0)") / F.lit(10**scale).cast("decimal(38,0)")).cast(f.spark_type)
    if not f.required:
        made = F.when(F.lit(not _FILLER.match(f.name)) & (_draw(seed, f"{salt}?", 10) >= 3), made)
    return made.cast(f.spark_type)


def synthesise(spark: SparkSession, layout: Layout, rows: dict[str, int] | int = 4, seed: int = 0) -> dict[str, DataFrame]:
    """Frames by record code: `rows` of each repeatable type, one of each other. Fields that equality rules can solve are left
    empty and completed, so totals, counts and products hold."""
    from cotejo.spec.writers import _solvable

    solved = {(c, n) for r in layout.rules for c, n, _ in _solvable(r.expression, layout, r.record if r.scope == "record" else None)}
    frames, line = {}, 0
    for r in sorted(layout.records, key=lambda r: {"first": 0, "last": 2}.get(r.place, 1)):
        n = _count(r, rows)
        base = spark.range(line + 1, line + n + 1).withColumnRenamed("id", "_line")
        line += n
        cells = [(F.lit(None).cast(f.spark_type) if (r.code, f.name) in solved and f.kind in ("integer", "decimal") else _value(f, seed, r.code)).alias(f.name) for f in r.fields]
        frames[r.code] = base.select("_line", *cells)
    return complete(frames, layout, spark)


def _count(r: Record, rows: dict[str, int] | int) -> int:
    if r.most == 1:
        return 1 if r.least else (rows.get(r.code, 0) if isinstance(rows, dict) else 1)
    wanted = rows.get(r.code, max(1, r.least)) if isinstance(rows, dict) else rows
    return max(r.least, wanted if r.most is None else min(wanted, r.most))
