"""Text of a field to a typed value or an error, and back, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cotejo.functions.text import strip
from cotejo.spec.layout import Field, java_date_format


def _quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), x, F.lit("'"))


def _first(*cases: tuple[Column, Column]) -> Column:
    out = None
    for condition, message in cases:
        out = F.when(condition, message) if out is None else out.when(condition, message)
    return F.lit(None).cast("string") if out is None else out


def _domain(f: Field, text: Column) -> list[tuple[Column, Column]]:
    cases = []
    if f.allowed:
        equal = text.isin(list(f.allowed))
        if f.kind in ("integer", "decimal"):  # 1 is 01
            number = text.try_cast("decimal(38,6)")
            equal = equal | F.coalesce(number.isin([F.lit(a).try_cast("decimal(38,6)") for a in f.allowed]), F.lit(False))
        cases.append((~equal, F.concat(_quoted(text), F.lit(f" is not one of {', '.join(f.allowed)}"))))
    if f.pattern:
        cases.append((~text.rlike(rf"^(?:{f.pattern})$"), F.concat(_quoted(text), F.lit(f" does not match {f.pattern}"))))
    return cases


def parse(f: Field, raw: Column, mode: str) -> tuple[Column, Column]:
    """(value, error): one of them is null, both where an optional field is empty. The first fault in order is told: width,
    missing, constant, length, domain, date, digits and decimals."""
    fixed = mode == "fixed"
    text = F.regexp_replace(raw, " +$", "") if fixed and f.kind in ("text", "constant") else strip(raw)
    text = F.coalesce(text, F.lit(""))
    cases = []
    if mode == "delimited_fixed":
        cases.append(((strip(raw) != "") & (F.length(raw) != f.width), F.concat(_quoted(raw), F.lit(f" has not the width {f.width}"))))
    missing = F.lit("required field is missing") if f.required else F.lit(None).cast("string")
    empty = text == ""
    if f.kind == "constant":
        wanted = (f.constant or "").strip()
        cases += [(empty, missing), (strip(text) != wanted, F.concat(F.lit(f"expected '{wanted}', found "), _quoted(text)))]
        value = strip(text)
    elif f.kind == "text":
        cases.append((empty, missing))
        if not fixed:
            cases.append((F.length(text) > f.length, F.concat(F.lit("length "), F.length(text).cast("string"), F.lit(f" is over {f.length}"))))
        cases += _domain(f, text)
        value = text
    elif f.kind == "date":
        java = java_date_format(f.date_mask or "")
        full = java if "dd" in java else java + "dd"
        filled = text if "dd" in java else F.concat(text, F.lit("01"))
        value = F.to_date(F.try_to_timestamp(filled, F.lit(full)))
        cases += [(empty, missing), (value.isNull() | (F.date_format(value, java) != text), F.concat(_quoted(text), F.lit(f" is no date {f.date_mask}")))]
    elif fixed:
        cases += [(empty, missing), (~raw.rlike("^[0-9]+$"), F.concat(_quoted(raw), F.lit(" has other characters than digits"))), *_domain(f, text)]
        scale = f.decimals if f.kind == "decimal" else 0
        whole = text.try_cast("decimal(38,0)")
        value = (whole / F.lit(10**scale).cast("decimal(38,0)") if scale else whole).try_cast(f.spark_type)
    else:
        digits = F.length(F.regexp_replace(F.regexp_replace(text, "[-.]", ""), "^0+(?=.)", ""))
        cases += [(empty, missing), (~text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.concat(_quoted(text), F.lit(" is no number")))]
        if f.kind == "integer":
            cases.append((text.contains("."), F.concat(_quoted(text), F.lit(" is no whole number"))))
        else:
            cases.append((text.rlike(rf"\.[0-9]{{{f.decimals + 1},}}$"), F.concat(_quoted(text), F.lit(f" has more than {f.decimals} decimals"))))
        cases += [(digits > f.length, F.concat(_quoted(text), F.lit(f" has more than {f.length} digits"))), *_domain(f, text)]
        value = text.try_cast(f.spark_type)
    error = _first(*cases)
    return F.when(error.isNull() & ~empty, value).cast(f.spark_type), error


def render(f: Field, value: Column, mode: str) -> tuple[Column, Column]:
    """(text, error) of a typed value. Numbers are rounded half up; empty optional fields are blank."""
    fixed, padded = mode == "fixed", mode in ("fixed", "delimited_fixed")
    if f.kind == "constant":
        value = F.coalesce(value, F.lit(f.constant))
    width = f.length if fixed else f.width
    blank = value.isNull() if f.kind in ("integer", "decimal", "date") else value.isNull() | (strip(value) == "")
    nothing = F.lit(" " * width) if padded else F.lit("") if mode == "delimited" else F.lit(None).cast("string")
    cases = [(blank, F.lit(f"required field {f.name} has no value") if f.required else F.lit(None).cast("string"))]
    if f.kind in ("text", "constant"):
        cases.append((F.length(value) > f.length, F.concat(_quoted(value), F.lit(f" is over the length {f.length} of {f.name}"))))
        text = F.rpad(value, f.length, " ") if padded else value
    elif f.kind == "date":
        text = F.date_format(value, java_date_format(f.date_mask or ""))
    else:
        scale = f.decimals if f.kind == "decimal" else 0
        number = F.round(value.cast("decimal(38,10)"), scale).cast(f"decimal(38,{scale})")
        bare = F.regexp_replace(F.regexp_replace(number.cast("string"), "[-.]", ""), "^0+(?=.)", "")
        if fixed:
            cases.append((number < 0, F.concat(number.cast("string"), F.lit(f" is negative and {f.name} has no sign"))))
        cases.append((F.length(bare) > f.length, F.concat(number.cast("string"), F.lit(f" is over the {f.length} digits of {f.name}"))))
        if fixed:
            text = F.lpad(bare, f.length, "0")
        elif mode == "delimited_fixed":
            digits = F.regexp_replace(number.cast("string"), "^-", "")
            text = F.when(number < 0, F.concat(F.lit("-"), F.lpad(digits, width - 1, "0"))).otherwise(F.lpad(digits, width, "0"))
        else:
            text = number.cast("string")
    error = _first(*cases)
    return F.when(blank, nothing).otherwise(text), error


def coerce(f: Field, given: Column) -> Column:
    """User input as the field's type: dates by the field's mask, then ISO, d/m/y, compact and year-month."""
    text = strip(given)
    if f.kind == "date":
        forms = ([java_date_format(f.date_mask)] if f.date_mask and "D" in f.date_mask.upper() else []) + ["yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd"]
        tried = [F.to_date(F.try_to_timestamp(text, F.lit(x))) for x in forms]
        tried.append(F.to_date(F.try_to_timestamp(F.concat(text, F.lit("-01")), F.lit("yyyy-MM-dd"))))
        return F.coalesce(*tried)
    if f.kind in ("integer", "decimal"):
        from cotejo.functions.text import parse_amount

        return F.round(parse_amount(text, currency=False), f.decimals if f.kind == "decimal" else 0).cast(f.spark_type)
    return F.when(text != "", text)
