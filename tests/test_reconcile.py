import pytest
from pyspark.sql import functions as F

from cotejo.operators.controls import Control, with_controls
from cotejo.operators.filters import Filter
from cotejo.operators.keys import key_strength, keys_are_clear, suggest_comparisons, suggest_keys, suggest_pair_key
from cotejo.operators.lookup import Lookup, apply_lookups, lookup_order, match_rates
from cotejo.operators.pairs import reconcile_pair
from cotejo.operators.reconcile import Group, GroupFile, build, group_statistics, reconcile
from cotejo.operators.totals import Term, Threshold, Totals, apply_totals


def numbered(spark, rows, names):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"`{n}` string" for n in names) + ", _pos long")


def test_three_groups_with_repeated_keys(spark):
    a = numbered(spark, [("1", "10"), ("1", "5"), ("2", "7"), ("3", "1")], ["id", "m"])
    b = numbered(spark, [("1", "15"), ("2", "8"), ("4", "2")], ["ref", "imp"])
    c = numbered(spark, [("001", "15,00"), ("002", "7"), ("005", "3")], ["k", "v"])
    groups = [Group("A", (GroupFile("a", a, ("id",), "no_zeros"),)), Group("B", (GroupFile("b", b, ("ref",), "no_zeros"),)), Group("C", (GroupFile("c", c, ("k",), "no_zeros"),))]
    r = reconcile(groups, [("m", "imp", "v")])
    m = {x.key: x for x in r.matrix.collect()}
    assert (m["1"].A__m, m["1"].rows_A, m["1"].state, m["1"].has_diff) == (15.0, 2, "in all", False)
    assert m["2"].differences == "A.m=7 vs B.imp=8 vs C.v=7 (diff. 1)"
    assert (m["3"].state, m["4"].state, m["5"].state) == ("only in A", "only in B", "only in C")
    s = r.summary().first()
    assert (s.universe, s.in_all, s.in_all_diff, s.only_in_A, s.coverage_A) == (5, 2, 1, 1, "2 of 3")
    assert r.warnings() == []


def test_difference_needs_the_key_in_all_groups(spark):
    frames = [numbered(spark, [("1", v)], ["id", "m"]) for v in ("1", "9")] + [numbered(spark, [("2", "1")], ["id", "m"])]
    groups = [Group(n, (GroupFile(n, f, ("id",)),)) for n, f in zip("ABC", frames)]
    assert reconcile(groups, [("m", "m")]).differences.count() == 0


def test_tolerance_has_its_epsilon(spark):
    a, b = numbered(spark, [("1", "0.30"), ("2", "1")], ["id", "m"]), numbered(spark, [("1", "0.29"), ("2", "1.02")], ["id", "m"])
    r = reconcile([Group("A", (GroupFile("a", a, ("id",)),)), Group("B", (GroupFile("b", b, ("id",)),))], [("m", "m")], 0.01)
    assert [x.key for x in r.differences.collect()] == ["2"]


def test_unique_values(spark):
    a = numbered(spark, [("1", "3", "10"), ("1", "3.0", "5"), ("2", "3", "1"), ("2", "5", "1"), ("3", "2", "1")], ["id", "rate", "m"])
    b = numbered(spark, [("1", "3,00", "15"), ("2", "3", "2"), ("3", "2.5", "1")], ["id", "alic", "m"])
    r = reconcile([Group("A", (GroupFile("a", a, ("id",)),)), Group("B", (GroupFile("b", b, ("id",)),))], [("rate", "alic"), ("m", "m")], functions=["unique", "sum"])
    told = {x.key: x.differences for x in r.differences.collect()}
    assert told == {"2": "A.rate=several values (3 to 5) vs B.alic=3", "3": "A.rate=2 vs B.alic=2.5 (diff. 0.5)"}


def test_totals_are_compared_as_unique(spark):
    a = numbered(spark, [("1", "g", "10"), ("1", "g", "20")], ["id", "grp", "m"])
    b = numbered(spark, [("1", "30")], ["id", "t"])
    r = reconcile([Group("A", (GroupFile("a", a, ("id",), totals=Totals((Term("m"),), ("grp",))),)), Group("B", (GroupFile("b", b, ("id",)),))], [("total", "t")])
    assert r.matrix.first().A__total == 30.0 and r.differences.count() == 0


def test_empty_keys_are_counted_and_left_out(spark):
    a = numbered(spark, [(None, "1"), ("  ", "2"), ("7", "3"), ("7", "4")], ["id", "m"])
    b = build(Group("A", (GroupFile("a", a, ("id", "gone")),)))
    assert tuple(group_statistics(b).first()) == (4, 2, 4, 2) and b.detail.count() == 2


def test_group_names_must_differ(spark):
    a = numbered(spark, [("1",)], ["id"])
    with pytest.raises(ValueError):
        reconcile([Group("A", (GroupFile("a", a, ("id",)),))] * 2)


def test_excluded_rows_carry_their_reason(spark):
    a = numbered(spark, [("1", "-3"), ("2", "4")], ["id", "m"])
    r = reconcile([Group("A", (GroupFile("a", a, ("id",), filters=(Filter("m", "<=", ("0",)),)),)), Group("B", (GroupFile("b", a, ("id",)),))])
    assert [(x.group, x.file, x.reason, x.id) for x in r.excluded.collect()] == [("A", "a", "drop m at most 0", "1")]


def test_chained_lookup_and_controls(spark):
    base = numbered(spark, [("20-1", "A", "3.5"), ("20-2", "A", "1"), ("20-3", "B", "2")], ["cuit", "jur", "alicuota"])
    padron = numbered(spark, [("201", "r"), ("202", "S"), ("201", "Z")], ["id", "letra"])
    table = numbered(spark, [("R", "3,50"), ("S", "2")], ["Letra", "tarifa"])
    group = Group(
        "G",
        (
            GroupFile("presented", base, ("cuit",), "digits"),
            GroupFile("table", table, ("Letra",), "folded", bring=("tarifa",), by=("letra",)),
            GroupFile("padron", padron, ("id",), "digits", bring=("letra",)),
        ),
        "lookup",
        controls=(Control("alicuota", "tarifa", name="rate"),),
    )
    built = build(group)
    assert {r.cuit: (r.tarifa, r["control rate"]) for r in built.detail.collect()} == {"20-1": ("3,50", "match"), "20-2": ("2", "differs"), "20-3": (None, "no data")}
    assert {r.lookup: r.rate for r in match_rates(built.all_rows, built.lookups).collect()} == {"table": "2 of 3 (66.7%)", "padron": "2 of 3 (66.7%)"}


def test_lookup_that_nobody_feeds(spark):
    base = numbered(spark, [("1",)], ["_key"])
    x = Lookup("x", numbered(spark, [("1", "v")], ["_key", "c"]), ("c",), ("missing",))
    assert lookup_order(base.columns, [x]) == ([], [x])
    assert tuple(apply_lookups(base, [x]).select("c", "_found_x").first()) == (None, False)


def test_controls(spark):
    df = spark.createDataFrame([("01.50", "1,5"), ("Ab c", "aBC"), ("x", "y"), ("", "1"), (None, "1"), ("1", "1.2"), ("nan", "1")], "a string, b string")
    assert [r[0] for r in with_controls(df, [Control("a", "b"), Control("a", "gone")]).select("control a = b").collect()] == ["match", "match", "differs", "no data", "no data", "differs", "no data"]


MOVES = [("d1", "1", "ene", "10", "-5", "100"), ("d1", "CPF", "ene", "20", "0", "50"), ("d2", "2", "ene", "5", "5", "10"), ("d2", "CNPJ", "feb", "7", "-1", "20"), ("d3", "9", "feb", "1", "1", "30"), ("d3", "9", "feb", None, "2", "x")]


def moves(spark):
    return numbered(spark, MOVES, ["doc", "kind", "month", "count", "deb", "cred"])


def test_terms_go_left_to_right(spark):
    rows = apply_totals(moves(spark), Totals((Term("count"), Term("deb", "-", True), Term("count", "*")), ("doc",), name="net")).rows
    assert [r.net for r in rows.orderBy("_pos").collect()] == [50.0, 400.0, 0.0, 42.0, 0.0, 0.0]
    assert {r.doc: r["total net"] for r in rows.collect()} == {"d1": 450.0, "d2": 42.0, "d3": 0.0}


def test_thresholds_by_category(spark):
    spec = Totals((Term("count"),), ("doc", "kind"), condition="category", category="kind", thresholds=(Threshold(">=", 20, ("CPF", "1")), Threshold(">", 6, ("CNPJ",))))
    done = apply_totals(moves(spark), spec)
    assert {r.kind for r in done.rows.collect()} == {"CPF", "CNPJ"}
    assert {(r.kind, r.reason) for r in done.excluded.collect()} == {("1", "group total does not meet the threshold"), ("2", "category without threshold"), ("9", "category without threshold")}
    assert sum(r.n_rows for r in done.report.collect()) == 6
    passing = apply_totals(moves(spark), Totals((Term("count"),), ("doc",), condition="category", category="kind", thresholds=spec.thresholds, others="pass"))
    assert "9" in {r.kind for r in passing.rows.collect()}


def test_no_threshold_lets_nothing_pass(spark):
    assert apply_totals(moves(spark), Totals((Term("count"),), ("doc",), condition="single")).rows.count() == 0


def test_division_by_zero_is_excluded_before_totals(spark):
    done = apply_totals(moves(spark), Totals((Term("cred"), Term("deb", "/")), ("month",)))
    assert [(r.deb, r.reason) for r in done.excluded.collect()] == [("0", "division by zero")]
    assert {r.month: r.total for r in done.report.collect()} == {"ene": -18.0, "feb": 10.0}


def test_total_of_the_whole_file(spark):
    assert {r.total for r in apply_totals(moves(spark), Totals((Term("count"),))).rows.collect()} == {43.0}


@pytest.mark.parametrize("companions,kind,count", [("sum", "1", 30.0), ("first", "1", "10"), ("last", "CPF", "20"), ("distinct", 2, 2)])
def test_summaries(spark, companions, kind, count):
    out = apply_totals(moves(spark), Totals((Term("count"),), ("doc",), output="summary", companions=companions)).rows
    row = out.filter("doc = 'd1'").first()
    assert (row.kind, row["count"], row.total, row.group_rows) == (kind, count, 30.0, 2)


def test_two_tables(spark):
    a = numbered(spark, [("001", "10", "x"), ("2", "5", "y"), ("2", "6", "y"), ("3", "1", "z"), (None, "1", "q")], ["k", "m", "t"])
    b = numbered(spark, [("1", "10,02", "x"), ("02", "5.01", " y"), ("9", "1", "w"), (None, "1", "q")], ["r", "v", "t2"])
    p = reconcile_pair(a, b, ["k"], ["r"], [("m", "v"), ("t", "t2")])
    assert {r.k for r in p.only_a.collect()} == {"3"} and {r.r for r in p.only_b.collect()} == {"9"}
    assert {r.key: r.differences for r in p.differences.collect()} == {"1": "m: 10 vs v: 10.02 (diff. -0.02)"}
    assert {r.key for r in p.equal.collect()} == {"2", ""}
    assert p.duplicates_a.count() == 2 and p.duplicates_b.count() == 0
    assert p.summary(a, b, ["k"], ["r"])["in both, equal"] == 2
    with pytest.raises(ValueError):
        reconcile_pair(a, b, [], [])


def test_shared_attribute_is_no_key(spark):
    a = spark.range(300).select((F.col("id") % 5 + 1000).cast("string").alias("Id_Cliente"), F.format_string("F%06d", F.col("id") + 5000).alias("Nro_Factura"))
    b = spark.range(280).select(F.format_string("%06d", F.col("id") + 5000).alias("Comprobante"), (F.col("id") % 5 + 1000).cast("string").alias("Id_Pagador"))
    found = suggest_keys([a, b])
    assert [k.column for k in found] == ["Nro_Factura", "Comprobante"] and keys_are_clear(found)


def test_pair_suggestions(spark):
    a = spark.range(50).select(F.format_string("%05d", "id").alias("comprobante"), F.lit("a").alias("x"))
    b = spark.range(50).select(F.col("id").cast("string").alias("numero_comprobante"), F.lit("b").alias("y"))
    assert [(p.left, p.right) for p in suggest_pair_key(a, b)] == [("comprobante", "numero_comprobante")]
    assert suggest_comparisons(["k", "importe_total"], ["r", "importe total"], ["k"], ["r"]) == [("importe_total", "importe total")]


def test_keys_are_judged_on_all_rows(spark):
    # One hot key holds the first 10,000 of 40,000 rows.
    key = F.when(F.col("id") < 10_000, F.lit(1_000_000)).otherwise(F.col("id") + 1_000_000).cast("string")
    a = spark.range(0, 40_000, 1, 1).select(key.alias("nro_factura"))
    b = spark.range(0, 40_000, 1, 1).select(key.alias("comprobante"))
    found = suggest_keys([a, b])
    assert [k.column for k in found] == ["nro_factura", "comprobante"] and keys_are_clear(found)
    assert key_strength(a, ["nro_factura"], b, ["comprobante"], "exact") == 1.0
