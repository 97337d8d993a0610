"""Computed columns, group totals, thresholds on them, and summaries: group-by with having over text cells.

A group's total is formed by an aggregate and joined back, not by a window: partial aggregation takes the weight off a hot
group, and the totals of few groups are broadcast by the optimiser.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import AMOUNT, format_number, free_name, is_blank, parse_amount, parse_number, strip
from cotejo.operators.filters import Filter

FUNCTIONS = ("sum", "count", "max", "min", "avg")
COMPANIONS = ("sum", "first", "last", "distinct")
BELOW, UNDEFINED, DIVISION = "group total does not meet the threshold", "category without threshold", "division by zero"
VALUE, TOTAL, THRESHOLD, CATEGORY = "value", "total", "threshold", "category"


@dataclass(frozen=True)
class Term:
    """A column of the formula; operation joins it to what stands left of it and is ignored in the first term."""

    column: str
    operation: str = "+"
    absolute: bool = False


@dataclass(frozen=True)
class Threshold:
    """A bound on the group total. values: the categories it is for; none: all that no other threshold takes."""

    comparison: str
    bound: float
    values: tuple[str, ...] = ()

    def met(self, total: Column) -> Column:
        b = F.lit(float(self.bound))
        return {">": total > b, ">=": total >= b, "<": total < b, "<=": total <= b}[self.comparison]

    @property
    def text(self) -> str:
        return f"{self.comparison} {f'{float(self.bound):.6f}'.rstrip('0').rstrip('.')}"


@dataclass(frozen=True)
class Totals:
    """condition: "none", "single" (the first threshold for all rows) or "category". others: "drop" or "pass" for rows without
    a threshold. output: "rows" or "summary", one row per group with companions in one of COMPANIONS."""

    terms: tuple[Term, ...] = ()
    group_by: tuple[str, ...] = ()
    function: str = "sum"
    condition: str = "none"
    category: str | None = None
    thresholds: tuple[Threshold, ...] = ()
    others: str = "drop"
    output: str = "rows"
    companions: str = "sum"
    show: tuple[str, ...] = (VALUE, TOTAL, THRESHOLD, CATEGORY)
    name: str = ""
    position: str = "_pos"

    def label(self, auxiliary: str) -> str:
        if not self.name.strip():
            return auxiliary
        return {VALUE: self.name.strip(), TOTAL: f"total {self.name.strip()}"}.get(auxiliary, auxiliary)

    @property
    def formula(self) -> str:
        body = " ".join((t.operation + " ") * (i > 0) + (f"|{t.column}|" if t.absolute else t.column) for i, t in enumerate(self.terms))
        return (f"{self.function}({body})" + f" by {', '.join(self.group_by)}" * bool(self.group_by)) if self.terms else self.function

    def value(self, columns: list[str]) -> Column:
        """Left to right; blank or missing cells are 0; x / 0 is null; six places, half even; without terms 1."""
        if not self.terms:
            return F.lit(1.0)
        out = None
        for t in self.terms:
            x = F.coalesce(parse_number(t.column), F.lit(0.0)) if t.column in columns else F.lit(0.0)
            x = F.abs(x) if t.absolute else x
            if out is None:
                out = x
            elif t.operation == "/":
                out = F.try_divide(out, x)
            else:
                out = {"+": out + x, "-": out - x, "*": out * x}[t.operation]
        return F.bround(out, 6)

    def _assigned(self, df: DataFrame) -> Column:
        """Index of the row's threshold, or null."""
        if self.condition == "single":
            return F.lit(0) if self.thresholds else F.lit(None).cast("int")
        if self.condition != "category" or self.category not in df.columns:
            return F.lit(None).cast("int")
        trimmed = F.coalesce(strip(self.category), F.lit(""))
        found = None
        for i, t in enumerate(self.thresholds):
            if t.values:
                by = Filter(self.category, "==", t.values)
                here = by.mask()
            else:
                here = F.lit(True)
            found = F.when(here, F.lit(i)) if found is None else found.when(here, F.lit(i))
        return F.lit(None).cast("int") if found is None else found


@dataclass
class TotalsResult:
    rows: DataFrame
    excluded: DataFrame
    report: DataFrame
    formula: str = field(default="")


def _total(function: str) -> Column:
    """Sums and means go over exact decimals, so they do not depend on the order of rows."""
    exact = F.col("_value").cast(AMOUNT)
    made = {"sum": F.sum(exact), "count": F.count("_value"), "max": F.max("_value"), "min": F.min("_value"), "avg": F.sum(exact).cast("double") / F.count("_value")}[function]
    return F.bround(made.cast("double"), 6)


def apply_totals(df: DataFrame, spec: Totals) -> TotalsResult:
    """Rows (or groups) that meet the condition, the excluded rows with their reason, and the count of rows by group total."""
    keys = [c for c in spec.group_by if c in df.columns]
    marked = df.withColumns({"_value": spec.value(df.columns)} | {f"_k{i}": F.coalesce(strip(c), F.lit("")) for i, c in enumerate(keys)})
    names = [f"_k{i}" for i in range(len(keys))]
    # Only a division can leave a row without value; else a filter on it would only form the value twice.
    divides = any(t.operation == "/" for t in spec.terms[1:])
    divided = marked.filter(F.col("_value").isNull() if divides else F.lit(False)).select(*df.columns, F.lit(DIVISION).alias("reason"))
    sound = marked.filter(F.col("_value").isNotNull()) if divides else marked
    totals = sound.groupBy(*names).agg(_total(spec.function).alias("_total"))
    # Without keys the totals are one row, whatever the input.
    joined = sound.join(totals, names) if names else sound.join(F.broadcast(totals.withColumn("_one", F.lit(0))), F.expr("_one = 0")).drop("_one")
    index = spec._assigned(sound)
    texts, met = F.lit(""), F.lit(False)
    for i, t in reversed(list(enumerate(spec.thresholds))):
        texts = F.when(F.col("_index") == i, F.lit(t.text)).otherwise(texts)
        met = F.when(F.col("_index") == i, t.met(F.col("_total"))).otherwise(met)
    passes = F.lit(True) if spec.condition == "none" else F.coalesce(met, F.lit(False)) | ((F.col("_index").isNull()) if spec.others == "pass" else F.lit(False))
    category = F.coalesce(strip(spec.category), F.lit("")) if spec.condition == "category" and spec.category in df.columns else F.lit("")
    judged = joined.withColumn("_index", index).withColumns({"_text": texts, "_passes": passes, "_category": category})

    shown = [*[F.col(n).alias(k) for n, k in zip(names, keys)], *([F.col("_category").alias(CATEGORY)] if spec.condition == "category" else [])]
    report = judged.groupBy(*shown, F.col("_total").alias(spec.label(TOTAL)), F.col("_text").alias(THRESHOLD), F.when(F.col("_passes"), "yes").otherwise("no").alias("passes")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    out = judged.filter(~F.col("_passes")).select(
        *df.columns, F.when(F.col("_index").isNull(), F.lit(UNDEFINED)).otherwise(F.lit(BELOW)).alias("reason"), F.col("_total").alias(spec.label(TOTAL)), F.col("_text").alias(THRESHOLD)
    )
    excluded = divided.unionByName(out, allowMissingColumns=True)
    good = judged.filter("_passes")
    auxiliary = {VALUE: "_value", TOTAL: "_total"} | ({THRESHOLD: "_text"} if spec.condition != "none" else {}) | ({CATEGORY: "_category"} if spec.condition == "category" else {})
    if spec.output == "summary" and keys:
        alone = spec.condition in ("none", "single")
        rows = _summary(sound if alone else good, df.columns, spec, keys, names, auxiliary, alone)
        return TotalsResult(rows, excluded, report, spec.formula)
    taken = list(df.columns)
    extra = []
    for a, c in auxiliary.items():
        if a in spec.show:
            taken.append(free_name(spec.label(a), taken))
            extra.append(F.col(c).alias(taken[-1]))
    return TotalsResult(good.select(*df.columns, *extra), excluded, report, spec.formula)


def first_value(c: str, position: str) -> Column:
    """First non-null value by position."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(position)))


def last_value(c: str, position: str) -> Column:
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(position)))


def _summary(rows: DataFrame, columns: list[str], spec: Totals, keys: list[str], names: list[str], auxiliary: dict[str, str], alone: bool) -> DataFrame:
    """One row per group. alone: all rows of a group pass or none, so the total and the companions come from one aggregate over
    all rows and the groups are judged after it; else rows are the passing ones, with their total beside them."""
    rest = [c for c in columns if c not in keys and not c.startswith("_")]
    summed = spec.companions == "sum"
    made = [F.count(F.lit(1)).alias("group_rows")]
    made += [_total(spec.function).alias("_total")] if alone else [F.min_by(F.col(c), F.col(spec.position)).alias(c) for c in auxiliary.values() if c != "_value"]
    for i, c in enumerate(rest):
        if spec.companions == "distinct":
            made.append(F.count_distinct(c).alias(f"_first{i}"))
            continue
        made.append((last_value if spec.companions == "last" else first_value)(c, spec.position).alias(f"_first{i}"))
        if summed:
            made.append(F.sum(F.coalesce(parse_amount(c), F.lit(0).cast(AMOUNT))).cast("double").alias(f"_sum{i}"))
            made += [F.bool_or(~is_blank(c)).alias(f"_filled{i}"), F.bool_and(is_blank(c) | parse_number(c).isNotNull()).alias(f"_number{i}")]
    grouped = rows.groupBy(*names).agg(*made)
    if alone:
        judging = spec.thresholds[:1] if spec.condition == "single" else ()
        free = spec.condition == "none" or spec.others == "pass"
        grouped = grouped.filter(F.coalesce(judging[0].met(F.col("_total")), F.lit(False)) if judging else F.lit(free)).withColumn("_text", F.lit(judging[0].text if judging else ""))
    # Which columns are numbers throughout decides the result's types, so it is asked now.
    told = grouped.agg(*[f(f"_{n}{i}").alias(f"{n}{i}") for i in range(len(rest)) for f, n in ((F.bool_or, "filled"), (F.bool_and, "number"))]).first() if summed and rest else None
    taken = [*keys, *rest]
    shown = [F.col(n).alias(k) for n, k in zip(names, keys)]
    shown += [F.col(f"_sum{i}" if told is not None and told[f"filled{i}"] and told[f"number{i}"] else f"_first{i}").alias(c) for i, c in enumerate(rest)]
    for a, c in auxiliary.items():
        if a != VALUE and (a in spec.show or a == TOTAL):
            taken.append(free_name(spec.label(a), taken))
            shown.append(F.col(c).alias(taken[-1]))
    return grouped.select(*shown, "group_rows")


def format_total(c: str) -> Column:
    return format_number(c)
