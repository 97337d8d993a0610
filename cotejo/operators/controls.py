"""Row controls: two columns of one row compared with a tolerance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import clean, parse_number

MATCH, DIFFERS, NO_DATA = "match", "differs", "no data"
#: Added to tolerances that compare binary floating-point amounts.
EPSILON = 1e-9


@dataclass(frozen=True)
class Control:
    left: str
    right: str
    tolerance: float = 0.0
    name: str = ""

    @property
    def title(self) -> str:
        return f"control {self.name or f'{self.left} = {self.right}'}"

    def state(self) -> Column:
        """NO_DATA if a side is blank; numbers within the tolerance, or equal text but for case and white space, MATCH."""
        a, b = (F.regexp_replace(F.upper(clean(c)), r"(?U)\s+", "") for c in (self.left, self.right))
        near = F.abs(parse_number(self.left) - parse_number(self.right)) <= F.lit(float(self.tolerance) + EPSILON)
        return F.when((a == "") | (b == ""), F.lit(NO_DATA)).when(F.coalesce(near, a == b), F.lit(MATCH)).otherwise(F.lit(DIFFERS))

    def applies(self, columns: list[str]) -> bool:
        return self.left in columns and self.right in columns


def with_controls(df: DataFrame, controls: list[Control]) -> DataFrame:
    return df.withColumns({c.title: c.state() for c in controls if c.applies(df.columns)})


def control_counts(df: DataFrame, control: Control) -> DataFrame:
    """(state, n_rows) of one control."""
    return df.groupBy(control.state().alias("state")).agg(F.count(F.lit(1)).alias("n_rows"))


def control_failures(df: DataFrame, controls: list[Control], group: str, key: str = "_key") -> DataFrame | None:
    """Rows whose state is not MATCH, one per control, with group, control, state and key in front."""
    shown = [c for c in df.columns if not c.startswith("_")]
    found = None
    for c in controls:
        if not c.applies(df.columns):
            continue
        rows = df.withColumn("_state", c.state()).filter(F.col("_state") != MATCH)
        rows = rows.select(F.lit(group).alias("group"), F.lit(c.title).alias("control"), F.col("_state").alias("state"), F.col(key).alias("key"), *shown)
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found
