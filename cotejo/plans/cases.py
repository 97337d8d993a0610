"""Synthetic reconciliation cases of known truth: a book and a bank that print keys, amounts and dates in their own ways."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.operators.filters import Filter
from cotejo.operators.keys import suggest_keys
from cotejo.operators.reconcile import Group, GroupFile, reconcile

#: Of 20 keys, those in each state; the rest agree. Voids are in both, and excluded by a filter on the bank's side.
SHARES = {"book": (16,), "bank": (17, 18), "different": (13, 14), "void": (19,)}
LOCALES = ("es", "en", "pt")


@dataclass(frozen=True)
class Case:
    book: DataFrame
    bank: DataFrame
    truth: DataFrame


def amount_text(cents: Column, locale: str) -> Column:
    shown = F.format_number(cents / 100, 2)
    if locale == "en":
        return shown
    swapped = F.translate(shown, ",.", ".,")
    return F.concat(F.lit("R$ "), swapped) if locale == "pt" else swapped


def date_text(day: Column, locale: str) -> Column:
    return F.date_format(day, "MM/dd/yyyy" if locale == "en" else "dd/MM/yyyy")


def disguised_key(number: Column) -> Column:
    return F.concat(F.lit("FC-"), F.lpad((number.cast("long") / 10_000).cast("int").cast("string"), 4, "0"), F.lit("-"), F.lpad((number % 10_000).cast("string"), 4, "0"))


def make_case(spark: SparkSession, n: int, seed: int, locale: str = "es") -> Case:
    """n keys; a key's state, amount and day follow from hashes of (seed, key), so a case is the same on any cluster."""
    if locale not in LOCALES:
        raise ValueError(f"unknown locale {locale!r}")
    draw = lambda name, top: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(top))
    base = spark.range(n).select((F.col("id") + 10_000).alias("number"), (draw("amount", 50_000_000) + 100).alias("cents"), F.date_add(F.lit("2024-01-01").cast("date"), draw("day", 366).cast("int")).alias("day"), draw("state", 20).alias("slot"))
    state = F.lit("equal")
    for name, slots in SHARES.items():
        state = F.when(F.col("slot").isin(*slots), F.lit(name)).otherwise(state)
    base = base.withColumn("truth", state)
    book = base.filter("truth <> 'bank'").select(F.col("number").cast("string").alias("comprobante"), amount_text(F.col("cents"), locale).alias("importe"), date_text(F.col("day"), locale).alias("fecha"), F.struct("number").alias("_pos"))
    off = F.when(F.col("truth") == "different", F.col("cents") + 100 + F.col("slot")).otherwise(F.col("cents"))
    bank = base.filter("truth <> 'book'").select(disguised_key(F.col("number")).alias("referencia"), amount_text(off, locale).alias("monto"), F.when(F.col("truth") == "void", F.lit("ANULADO")).otherwise(F.lit("OK")).alias("estado"), F.struct("number").alias("_pos"))
    # A void is excluded from the bank, so its key is left in the book alone.
    truth = base.select(F.col("number").cast("string").alias("key"), F.when(F.col("truth") == "void", F.lit("book")).otherwise(F.col("truth")).alias("truth"))
    return Case(book, bank, truth)


def run_case(case: Case, form: str = "digits", exclude: bool = True, tolerance: float = 0.01) -> DataFrame:
    """(key, state) with the states of a case's truth."""
    filters = (Filter("estado", "==", ("ANULADO",)),) if exclude else ()
    groups = [Group("book", (GroupFile("book", case.book, ("comprobante",), form),)), Group("bank", (GroupFile("bank", case.bank, ("referencia",), form, filters),))]
    m = reconcile(groups, [("importe", "monto")], tolerance).matrix
    return m.select("key", F.when(~F.col("in_bank"), F.lit("book")).when(~F.col("in_book"), F.lit("bank")).when(F.col("has_diff"), F.lit("different")).otherwise(F.lit("equal")).alias("state"))


def accuracy(case: Case, states: DataFrame) -> DataFrame:
    """(right, total) over the keys of the truth."""
    joined = case.truth.join(states, "key", "left")
    return joined.agg(F.count_if(F.col("state") == F.col("truth")).alias("right"), F.count(F.lit(1)).alias("total"))


def key_found(case: Case) -> bool:
    """Whether the key suggestion finds the true columns and a form in which they agree."""
    found = suggest_keys([case.book.drop("_pos"), case.bank.drop("_pos")])
    return all(found) and [k.column for k in found] == ["comprobante", "referencia"] and found[0].form == "digits"
