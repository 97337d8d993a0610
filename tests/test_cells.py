import pytest
from pyspark.sql import functions as F

from cotejo.functions.text import composite_key, format_number, free_name, key_form, number_of, pair_key, parse_number, snake_name
from cotejo.operators.filters import Filter, split_by_filters, with_reason

NUMBERS = [
    ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("12,5", 12.5), ("$ 100", 100.0), ("R$ 1.234,56", 1234.56), ("US$ 7", 7.0), ("€5,5", 5.5), ("000000000000000280.38", 280.38),
    (None, None), ("abc", None), ("-5", -5.0), ("+3", 3.0), ("12d", None), ("inf", None), ("NaN", None), ("", None), (" ", None), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("A1", 1.0), ("RET-000101", -101.0), ("1 234,5", 1234.5),
]


@pytest.mark.parametrize("text,value", NUMBERS)
def test_numbers(spark, text, value):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(parse_number("x")).first()[0] == value
    if text is not None:
        assert number_of(text) == value


def test_strict_numbers_take_known_currencies_only(spark):
    df = spark.createDataFrame([("A1",), ("R$ 5",), ("EUR5",)], "x string")
    assert [r[0] for r in df.select(parse_number("x", strict=True)).collect()] == [None, 5.0, 5.0]


FORMS = [
    ("  00123-4 ", "00123-4", "1234", "123-4", "00123-4"), ("000", "000", "0", "0", "000"), ("abc", "abc", "", "abc", "ABC"), ("NaN", "", "", "", ""), (None, "", "", "", ""), ("None", "", "", "", ""),
    ("Ñandú é", "Ñandú é", "", "Ñandú é", "NANDUE"), ("<NA>", "", "", "", ""),
]


@pytest.mark.parametrize("raw,exact,digits,no_zeros,folded", FORMS)
def test_key_forms(spark, raw, exact, digits, no_zeros, folded):
    df = spark.createDataFrame([(raw,)], "x string")
    row = df.select(*[key_form("x", f) for f in ("exact", "digits", "no_zeros", "folded")]).first()
    assert tuple(row) == (exact, digits, no_zeros, folded)


def test_folding_spells_out_ligatures(spark):
    df = spark.createDataFrame([("ﬁn ½",), ("Straße Å",), ("№ 5 ㎏ 𝐀",)], "x string")
    assert [r[0] for r in df.select(key_form("x", "folded")).collect()] == ["FIN12", "STRAEA", "NO5KGA"]


def test_group_marks_and_decimal_marks(spark):
    texts = ["1,234.567,8", "1.234,567.8", "1,234,567", "1.234.567", "1.234.567,89", "1,234,567.89", "-1.234,5e2", "1@5", "12,", ",5", "1,5,5", "\u00a07,25\u2003", "1'5"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    wanted = [None, None, None, None, 1234567.89, 1234567.89, -123450.0, None, 12.0, 0.5, None, 7.25, None]
    assert [r[0] for r in df.select(parse_number("x")).collect()] == wanted == [number_of(t) for t in texts]


def test_composite_keys(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "  ")], "x string, y string")
    assert [r[0] for r in df.select(composite_key(["x", "y", "z"], "exact", df.columns)).collect()] == ["a|b|c|", "a|b|c|", "||"]
    assert [r[0] for r in df.select(pair_key(["x", "y"])).collect()] == ["a|b|c", "a|b|c", "|0"]


def test_small_helpers(spark):
    df = spark.createDataFrame([(1.5,), (2.0,), (None,), (0.1234567,)], "x double")
    assert [r[0] for r in df.select(format_number("x")).collect()] == ["1.5", "2", "", "0.123457"]
    assert free_name("total", ["total", "total (2)"]) == "total (3)"
    assert snake_name(" Año  Móvil-1 ") == "ano_movil_1"


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([("1", "a, b", "10"), ("2", " ", "-5"), ("3", None, "0"), ("4", "Alta", "100.00"), ("5", "x", "7")], "id string, note string, amount string")


FILTERS = [
    (Filter("amount", "==", ("100",)), {"4"}), (Filter("amount", "==", ("100.0", "7,0")), {"4", "5"}), (Filter("amount", "!=", ("100",)), {"1", "2", "3", "5"}),
    (Filter("amount", "<=", ("0",)), {"2", "3"}), (Filter("amount", ">", ("x",)), set()), (Filter("note", "contains", ("A",)), {"1", "4"}), (Filter("note", "==", ("a, b",)), {"1"}),
    (Filter("note", "blank"), {"2", "3"}), (Filter("note", "not blank"), {"1", "4", "5"}), (Filter("note", "!=", ("x",)), {"1", "2", "3", "4"}), (Filter("amount", "<", ("7",)), {"2", "3"}),
]


@pytest.mark.parametrize("f,met", FILTERS)
def test_filter(sales, f, met):
    assert {r.id for r in sales.filter(f.mask()).collect()} == met
    kept, dropped = split_by_filters(sales, [f])
    assert {r.id for r in dropped.collect()} == met and kept.count() == 5 - len(met)


def test_keep_and_chain(sales):
    told = with_reason(sales, [Filter("note", "blank"), Filter("amount", ">=", ("10",), "keep"), Filter("note", "=="), Filter("gone", "blank")])
    assert {r.id: r.reason for r in told.collect()} == {"1": None, "2": "drop note is blank", "3": "drop note is blank", "4": None, "5": "keep only amount at least 10"}


def test_number_filters_on_columns_without_numbers(sales):
    assert [Filter("note", o, ("1", "2")).mask() is not None and sales.filter(Filter("note", o, ("1", "2")).mask()).count() for o in ("==", "!=")] == [0, 5]


def test_unknown_operator():
    with pytest.raises(ValueError):
        Filter("a", "~")


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_orderstatus").filter(F.col("o_orderstatus") == "F")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in df._jdf.queryExecution().toString()
