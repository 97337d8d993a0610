"""Reference lookups: ordered left joins against references with one row per key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import composite_key

FOUND = "_found_"


@dataclass(frozen=True)
class Lookup:
    """bring: columns to fetch. by: columns of the base, or fetched by an earlier lookup, to search with; none: the base's key."""

    name: str
    reference: DataFrame
    bring: tuple[str, ...]
    by: tuple[str, ...] = ()
    form: str = "exact"
    position: str = "_pos"


def first_rows(df: DataFrame, key: str, position: str, columns: list[str]) -> DataFrame:
    """One row per key: that of the least position. A partial aggregate instead of a window, so a hot key is reduced before
    the shuffle."""
    values = F.struct(*[F.col(c) for c in columns]) if columns else F.lit(None)
    one = df.groupBy(key).agg(F.min_by(values, F.col(position)).alias("_one"))
    return one.select(key, *[F.col(f"_one.{c}").alias(c) for c in columns])


def lookup_order(base: list[str], lookups: list[Lookup]) -> tuple[list[Lookup], list[Lookup]]:
    """(in an order in which each finds its columns, those that never do)."""
    known, waiting, ordered = set(base), list(lookups), []
    while waiting:
        ready = next((x for x in waiting if set(x.by) <= known), None)
        if ready is None:
            break
        waiting.remove(ready)
        ordered.append(ready)
        known |= {c for c in ready.bring if c in ready.reference.columns}
    return ordered, waiting


def apply_lookups(base: DataFrame, lookups: list[Lookup], key: str = "_key") -> DataFrame:
    """base with the fetched columns and a boolean `_found_<name>` per lookup; Catalyst picks the join by the reference's size.

    References carry their key in `key`. Lookups whose search columns nobody brings give null columns and are never found.
    """
    ordered, stuck = lookup_order(base.columns, lookups)
    for x in ordered:
        bring = [c for c in x.bring if c in x.reference.columns and c not in base.columns]
        one = first_rows(x.reference, key, x.position, bring).withColumnRenamed(key, "_search").withColumn(FOUND + x.name, F.lit(True))
        search = composite_key(list(x.by), x.form, base.columns) if x.by else F.col(key)
        base = base.withColumn("_search", search).join(one, "_search", "left").drop("_search")
        base = base.withColumn(FOUND + x.name, F.coalesce(F.col(FOUND + x.name), F.lit(False)))
    for x in stuck:
        base = base.withColumns({c: F.lit(None).cast("string") for c in x.bring if c not in base.columns} | {FOUND + x.name: F.lit(False)})
    return base


def match_rates(base: DataFrame, lookups: list[Lookup]) -> DataFrame:
    """One row per lookup: lookup, n_found, n_rows, rate ("n of m (p%)")."""
    counts = base.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(FOUND + x.name)).alias(f"f{i}") for i, x in enumerate(lookups)])
    rows = F.array(*[F.struct(F.lit(x.name).alias("lookup"), F.col(f"f{i}").alias("n_found"), F.col("n").alias("n_rows")) for i, x in enumerate(lookups)])
    said = F.format_string("%d of %d (%.1f%%)", "n_found", "n_rows", 100.0 * F.col("n_found") / F.greatest(F.col("n_rows"), F.lit(1)))
    return counts.select(F.inline(rows)).withColumn("rate", said)
