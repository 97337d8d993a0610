"""Two-table reconciliation: full outer on the key with one row per key, exact decimal comparison."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import pair_key, parse_amount, strip
from cotejo.operators.lookup import first_rows


@dataclass
class PairResult:
    only_a: DataFrame
    only_b: DataFrame
    matched: DataFrame
    duplicates_a: DataFrame
    duplicates_b: DataFrame
    tolerance: str

    @property
    def differences(self) -> DataFrame:
        return self.matched.filter(F.col("differences") != "")

    @property
    def equal(self) -> DataFrame:
        return self.matched.filter(F.col("differences") == "").drop("differences")

    def counts(self, a: DataFrame, b: DataFrame, key_a: list[str], key_b: list[str]) -> DataFrame:
        """(measure, n), all counted in one job."""
        told = self.matched.select(F.when(F.col("differences") != "", F.lit("in both, different")).otherwise(F.lit("in both, equal")).alias("measure"))
        parts = {
            "rows A": a, "rows B": b, "only in A": self.only_a, "only in B": self.only_b,
            "repeated keys in A": self.duplicates_a.select(pair_key(key_a)).distinct(), "repeated keys in B": self.duplicates_b.select(pair_key(key_b)).distinct(),
        }
        rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("measure")) for name, df in parts.items()], told)
        names = a.sparkSession.createDataFrame([(n,) for n in (*parts, "in both, different", "in both, equal")], "measure string")
        counted = rows.groupBy("measure").agg(F.count(F.lit(1)).alias("n"))
        return F.broadcast(names).join(counted, "measure", "left").select("measure", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def summary(self, a: DataFrame, b: DataFrame, key_a: list[str], key_b: list[str]) -> dict[str, object]:
        order = ("rows A", "rows B", "only in A", "only in B", "in both, different", "in both, equal", "repeated keys in A", "repeated keys in B")
        counted = {r.measure: r.n for r in self.counts(a, b, key_a, key_b).collect()}
        return {n: counted[n] for n in order} | {"key": f"{'+'.join(key_a)} <-> {'+'.join(key_b)}", "tolerance": self.tolerance}


def repeated_rows(df: DataFrame, key: str = "_key") -> DataFrame:
    """All rows whose key repeats: keys are counted first, so that a hot key is never gathered in a window."""
    several = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    return df.join(several, key, "left_semi")


def _difference(a: str, b: str, left: Column, right: Column, tolerance: str) -> Column:
    x, y = parse_amount(left, currency=False), parse_amount(right, currency=False)
    gap = x - y
    show = lambda c: F.regexp_replace(c.cast("string"), r"\.?0+$", "")
    numbers = F.when(F.abs(gap) > F.lit(tolerance).cast("decimal(28,6)"), F.concat(F.lit(f"{a}: "), show(x), F.lit(f" vs {b}: "), show(y), F.lit(" (diff. "), show(gap), F.lit(")")))
    s, t = F.coalesce(strip(left), F.lit("nan")), F.coalesce(strip(right), F.lit("nan"))
    words = F.when(s != t, F.concat(F.lit(f"{a}: '"), F.coalesce(left.cast("string"), F.lit("nan")), F.lit(f"' vs {b}: '"), F.coalesce(right.cast("string"), F.lit("nan")), F.lit("'")))
    return F.when(x.isNotNull() & y.isNotNull(), numbers).otherwise(words)


def reconcile_pair(a: DataFrame, b: DataFrame, key_a: list[str], key_b: list[str], compare: list[tuple[str, str]] = (), tolerance: str = "0.01", position: str = "_pos") -> PairResult:
    """a and b carry their row order in `position`. Rows with one key on one side only come back whole, repeats included; of
    matched keys the first row of each side is compared, strictly beyond the tolerance."""
    if not key_a or len(key_a) != len(key_b):
        raise ValueError("the key needs as many columns in A as in B")
    ka, kb = a.withColumn("_key", pair_key(key_a)), b.withColumn("_key", pair_key(key_b))
    only_a = ka.join(kb.select("_key").distinct(), "_key", "left_anti").drop("_key")
    only_b = kb.join(ka.select("_key").distinct(), "_key", "left_anti").drop("_key")
    ca, cb = list(dict.fromkeys(x for x, _ in compare)), list(dict.fromkeys(y for _, y in compare))
    one_a = first_rows(ka, "_key", position, ca).select("_key", *[F.col(c).alias(f"A.{c}") for c in ca])
    one_b = first_rows(kb, "_key", position, cb).select("_key", *[F.col(c).alias(f"B.{c}") for c in cb])
    both = one_a.join(one_b, "_key")
    told = F.concat_ws("; ", *[_difference(x, y, F.col(f"`A.{x}`"), F.col(f"`B.{y}`"), tolerance) for x, y in compare]) if compare else F.lit("")
    matched = both.withColumn("differences", told).withColumnRenamed("_key", "key")
    return PairResult(only_a, only_b, matched, repeated_rows(ka).drop("_key"), repeated_rows(kb).drop("_key"), tolerance)
