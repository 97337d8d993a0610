"""N-way reconciliation: any number of groups of files, aligned on a normalised key.

The groups' rows are united, tagged with their group's number, and reduced by one aggregate on the key with conditional
sums: one shuffle for all groups, reduced before it, where a chain of full outer joins would shuffle at every step and need
every group reduced beforehand.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import AMOUNT, KEY_SEPARATOR, composite_key, format_number, parse_amount, parse_number
from cotejo.operators.controls import EPSILON, Control, control_failures, with_controls
from cotejo.operators.filters import Filter, split_by_filters
from cotejo.operators.lookup import FOUND, Lookup, apply_lookups, match_rates
from cotejo.operators.totals import TOTAL, THRESHOLD, Totals, apply_totals, first_value

#: "sum_by_key" is an alias of "concat": amounts are summed by key in every mode.
MODES = ("concat", "lookup", "sum_by_key")


@dataclass(frozen=True)
class GroupFile:
    """A table, its key and what is done to its rows. bring and by only matter for the references of a "lookup" group."""

    name: str
    table: DataFrame
    key: tuple[str, ...]
    form: str = "exact"
    filters: tuple[Filter, ...] = ()
    totals: Totals | None = None
    bring: tuple[str, ...] = ()
    by: tuple[str, ...] = ()
    position: str = "_pos"


@dataclass(frozen=True)
class Group:
    name: str
    files: tuple[GroupFile, ...]
    mode: str = "concat"
    amounts: tuple[str, ...] = ()
    controls: tuple[Control, ...] = ()

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")


@dataclass
class Prepared:
    rows: DataFrame
    excluded: list[DataFrame]
    report: DataFrame | None


def _tagged(df: DataFrame, file: str) -> DataFrame:
    return df if "file" in df.columns else df.select(F.lit(file).alias("file"), *df.columns)


def prepare(file: GroupFile) -> Prepared:
    """Filters, then totals, then the key: `_key` and `_file`."""
    rows, dropped = split_by_filters(file.table, list(file.filters))
    excluded = [_tagged(dropped, file.name)] if file.filters else []
    report = None
    if file.totals is not None:
        done = apply_totals(rows, file.totals)
        rows, report = done.rows, _tagged(done.report, file.name)
        excluded.append(_tagged(done.excluded, file.name))
    keyed = rows.withColumn("_key", composite_key(list(file.key), file.form, rows.columns)).withColumn("_file", F.lit(file.name))
    return Prepared(keyed, excluded, report)


def empty_key() -> Column:
    return F.replace(F.col("_key"), F.lit(KEY_SEPARATOR), F.lit("")) == ""


@dataclass
class Built:
    detail: DataFrame
    all_rows: DataFrame
    excluded: DataFrame | None
    report: DataFrame | None
    lookups: list[Lookup] = field(default_factory=list)


def _union(frames: list[DataFrame]) -> DataFrame | None:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def build(group: Group) -> Built:
    """The group's rows with `_key` and control columns. Rows with an empty key are left out of detail, not of all_rows."""
    prepared = [prepare(f) for f in group.files]
    lookups: list[Lookup] = []
    if group.mode == "lookup" and len(prepared) > 1:
        lookups = [Lookup(f.name, p.rows, f.bring, f.by, f.form, f.position) for f, p in zip(group.files[1:], prepared[1:])]
        rows = apply_lookups(prepared[0].rows, lookups)
    else:
        rows = _union([p.rows for p in prepared])
    visible = rows.drop(*[FOUND + x.name for x in lookups])
    detail = with_controls(visible.filter(~empty_key()), list(group.controls))
    return Built(detail, rows, _union([e for p in prepared for e in p.excluded]), _union([p.report for p in prepared if p.report is not None]), lookups)


def group_statistics(built: Built) -> DataFrame:
    """One row: n_rows, n_keys, n_repeated_rows (rows whose key repeats), n_empty_keys; keys are counted before they are dropped."""
    per_key = built.all_rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_repeated_rows"),
        F.coalesce(F.sum(F.when(empty_key(), F.col("n"))), F.lit(0)).alias("n_empty_keys"),
    )


def per_key(detail: DataFrame, amounts: list[str], unique: list[str] = (), position: str = "_pos") -> DataFrame:
    """One row per key: amounts summed, a unique column's one value (or null and a text of its range), the first non-null
    value of all else, and the number of rows."""
    others = [c for c in detail.columns if c not in (*amounts, *unique, "_key", position) and not c.startswith("_")]
    made = [first_value(c, position).alias(c) for c in others]
    made += [_sum(c).cast("double").alias(c) for c in amounts if c in detail.columns]
    for c in unique:
        made += [*_range(c, None, c)]
    out = detail.groupBy("_key").agg(*made, F.count(F.lit(1)).alias("_rows"))
    return out.withColumns({c: _one_value(c) for c in unique} | {f"_several {c}": _several(c) for c in unique}).drop(*[f"_{x}_{c}" for c in unique for x in ("min", "max")])


def _sum(c: str, when: Column | None = None) -> Column:
    x = F.coalesce(parse_amount(c), F.lit(0).cast(AMOUNT))
    return F.sum(x if when is None else F.when(when, x))


def _range(c: str, when: Column | None, name: str) -> list[Column]:
    x = parse_number(c) if when is None else F.when(when, parse_number(c))
    return [F.bround(F.min(x), 6).alias(f"_min_{name}"), F.bround(F.max(x), 6).alias(f"_max_{name}")]


def _one_value(name: str) -> Column:
    return F.when(F.col(f"_min_{name}") == F.col(f"_max_{name}"), F.col(f"_min_{name}"))


def _several(name: str) -> Column:
    low, high = F.col(f"_min_{name}"), F.col(f"_max_{name}")
    return F.when(low != high, F.concat(format_number(low), F.lit(" to "), format_number(high))).otherwise(F.lit(""))


@dataclass
class Reconciliation:
    """Lazy frames. matrix: key; in_<g>, rows_<g>; <g>__<column> per comparison; in_all; state; differences; has_diff."""

    groups: list[Group]
    built: list[Built]
    matrix: DataFrame
    tolerance: float

    @property
    def differences(self) -> DataFrame:
        return self.matrix.filter("has_diff").select("key", "differences")

    @property
    def universe(self) -> DataFrame:
        """The matrix in the order of its keys' text, for readers of the whole; the sort is a range shuffle."""
        return self.matrix.orderBy("key")

    @property
    def ordered_differences(self) -> DataFrame:
        return self.differences.orderBy("key")

    def only(self, state: str) -> DataFrame:
        return self.matrix.filter(F.col("state") == state)

    @property
    def excluded(self) -> DataFrame | None:
        return _union([b.excluded.select(F.lit(g.name).alias("group"), *b.excluded.columns) for g, b in zip(self.groups, self.built) if b.excluded is not None])

    @property
    def totals(self) -> DataFrame | None:
        return _union([b.report.select(F.lit(g.name).alias("group"), *b.report.columns) for g, b in zip(self.groups, self.built) if b.report is not None])

    @property
    def controls(self) -> DataFrame | None:
        return _union([f for g, b in zip(self.groups, self.built) if (f := control_failures(b.detail, list(g.controls), g.name)) is not None])

    def summary(self) -> DataFrame:
        """One row over the matrix: universe, in_all, in_all_diff, in_all_equal, tolerance; per group only_in_<g> and coverage_<g>."""
        made = [
            F.count(F.lit(1)).alias("universe"),
            F.count_if("in_all").alias("in_all"),
            F.count_if("has_diff").alias("in_all_diff"),
            (F.count_if("in_all") - F.count_if("has_diff")).alias("in_all_equal"),
            F.lit(str(self.tolerance)).alias("tolerance"),
        ]
        for g in self.groups:
            others = reduce(and_, [~F.col(f"in_{o.name}") for o in self.groups if o is not g], F.lit(True))
            made.append(F.count_if(F.col(f"in_{g.name}") & others).alias(f"only_in_{g.name}"))
            made.append(F.concat(F.count_if("in_all").cast("string"), F.lit(" of "), F.count_if(f"in_{g.name}").cast("string")).alias(f"coverage_{g.name}"))
        return self.matrix.agg(*made)

    def lookup_rates(self) -> DataFrame | None:
        return _union([match_rates(b.all_rows, b.lookups).select(F.lit(g.name).alias("group"), "*") for g, b in zip(self.groups, self.built) if b.lookups])

    def warnings(self) -> list[str]:
        """Lookups that find less than a tenth of the rows; keys common to all fewer than a tenth of the smallest group."""
        said = []
        rates = self.lookup_rates()
        for r in rates.collect() if rates is not None else []:
            if r.n_rows and r.n_found < 0.1 * r.n_rows:
                said.append(f"{r.lookup}: only {r.rate} found")
        row = self.matrix.agg(F.count_if("in_all").alias("all"), *[F.count_if(f"in_{g.name}").alias(f"n{i}") for i, g in enumerate(self.groups)]).first()
        least = min(row[f"n{i}"] for i in range(len(self.groups)))
        if least and row["all"] < 0.1 * least:
            said.append(f"only {row['all']} keys are in all groups; the smallest has {least}")
        return said


def reconcile(groups: list[Group], compare: list[tuple[str, ...]] = (), tolerance: float = 0.01, functions: list[str] = ()) -> Reconciliation:
    """compare: one column per group, in the order of groups (shorter tuples compare the first groups). functions: "sum" (by
    key, within the tolerance) or "unique" (the one value of the key, without tolerance) per comparison."""
    if len({g.name for g in groups}) < len(groups):
        raise ValueError("group names must differ")
    functions = [*functions, *["sum"] * (len(compare) - len(functions))]
    # A total or threshold stands on every row of its group: summing it by key would multiply it.
    repeated = {TOTAL, THRESHOLD} | {f.totals.label(TOTAL) for g in groups for f in g.files if f.totals is not None}
    functions = ["unique" if any(c in repeated for c in t) else fn for t, fn in zip(compare, functions)]
    built = [build(g) for g in groups]

    sides: dict[tuple[int, str, str], str] = {}  # (group, column, function): name in the matrix
    for t, fn in zip(compare, functions):
        for i, c in enumerate(t[: len(groups)]):
            if c in built[i].detail.columns:
                sides[(i, c, fn)] = f"{groups[i].name}__{c}"
    for i, g in enumerate(groups):
        for c in g.amounts:
            if c in built[i].detail.columns and (i, c, "unique") not in sides:
                sides.setdefault((i, c, "sum"), f"{g.name}__{c}")
    columns = sorted({c for _, c, _ in sides})
    frames = []
    for i, b in enumerate(built):
        own = {c for j, c, _ in sides if j == i}
        frames.append(b.detail.select("_key", F.lit(i).alias("_g"), *[(F.col(c).cast("string") if c in own else F.lit(None).cast("string")).alias(f"_v{n}") for n, c in enumerate(columns)]))
    at = {c: f"_v{n}" for n, c in enumerate(columns)}
    made = []
    for i in range(len(groups)):
        made.append(F.count_if(F.col("_g") == i).alias(f"_rows{i}"))
    for (i, c, fn), name in sides.items():
        here = F.col("_g") == i
        made += [_sum(at[c], here).cast("double").alias(name)] if fn == "sum" else _range(at[c], here, name)
    m = _union(frames).groupBy("_key").agg(*made)
    m = m.withColumns({name: _one_value(name) for (_, _, fn), name in sides.items() if fn == "unique"} | {f"_several_{name}": _several(name) for (_, _, fn), name in sides.items() if fn == "unique"})
    present = [F.col(f"_rows{i}") > 0 for i in range(len(groups))]
    m = m.withColumn("in_all", reduce(and_, present))
    names = F.concat_ws(" + ", *[F.when(p, F.lit(g.name)) for p, g in zip(present, groups)])
    m = m.withColumn("state", F.when(F.col("in_all"), F.lit("in all")).otherwise(F.concat(F.lit("only in "), names)))
    texts = []
    for t, fn in zip(compare, functions):
        cells = [(groups[i].name, c, sides[(i, c, fn)]) for i, c in enumerate(t[: len(groups)]) if (i, c, fn) in sides]
        if len(cells) < 2:
            continue
        values = [F.col(name) for _, _, name in cells]
        least2 = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values]) >= 2
        gap = F.bround(F.greatest(*values) - F.least(*values), 6)
        slack = (0.0 if fn == "unique" else float(tolerance)) + EPSILON
        shown = F.concat_ws(" vs ", *[F.concat(F.lit(f"{g}.{c}="), format_number(name)) for g, c, name in cells])
        texts.append(F.when(F.col("in_all") & least2 & (gap > slack), F.concat(shown, F.lit(" (diff. "), format_number(gap), F.lit(")"))))
        if fn == "unique":
            some = reduce(or_, [F.col(f"_several_{name}") != "" for _, _, name in cells])
            parts = [F.concat(F.lit(f"{g}.{c}="), F.when(F.col(f"_several_{n}") != "", F.concat(F.lit("several values ("), F.col(f"_several_{n}"), F.lit(")"))).otherwise(format_number(n))) for g, c, n in cells]
            texts.append(F.when(F.col("in_all") & some, F.concat_ws(" vs ", *parts)))
    told = F.concat_ws("; ", *texts) if texts else F.lit("")
    m = m.withColumn("differences", told).withColumn("has_diff", F.col("differences") != "")
    matrix = m.select(
        F.col("_key").alias("key"),
        *[x for i, g in enumerate(groups) for x in (present[i].alias(f"in_{g.name}"), F.col(f"_rows{i}").alias(f"rows_{g.name}"))],
        *dict.fromkeys(sides.values()),
        "in_all",
        "state",
        "differences",
        "has_diff",
    )
    return Reconciliation(list(groups), built, matrix, tolerance)
