import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from cotejo.sources.lines import read_lines
from cotejo.spec.layout import Field, Layout, Record, Rule, java_date_format, layout_from, layout_problems
from cotejo.spec.readers import detect_layout, parse_delimited, parse_fixed, read_records, table_of
from cotejo.spec.rules import RuleError, check_rule, evaluate, violations
from cotejo.spec.validate import validate
from cotejo.spec.values import parse
from cotejo.spec.writers import complete, records_from, render_lines, render_xml, write_lines, xml_schema

HEAD = Record("CAB", fields=(Field("kind", "constant", 1, 3, constant="CAB"), Field("day", "date", 4, 8, date_mask="AAAAMMDD"), Field("rest", "text", 12, 19, required=False)), place="first")
ACCOUNT = Record("CTA", fields=(Field("kind", "constant", 1, 3, constant="CTA"), Field("number", "text", 4, 6), Field("credits", "decimal", 10, 10, decimals=2), Field("type", "text", 20, 1, allowed=("P", "C")), Field("due", "date", 21, 8, date_mask="AAAAMMDD", required=False), Field("rest", "text", 29, 2, required=False)), most=None)
MOVE = Record("MOV", fields=(Field("kind", "constant", 1, 3, constant="MOV"), Field("number", "text", 4, 6), Field("amount", "decimal", 10, 10, decimals=2), Field("side", "text", 20, 1), Field("rest", "text", 21, 10, required=False)), least=0, most=None)
TOTAL = Record("TOT", fields=(Field("kind", "constant", 1, 3, constant="TOT"), Field("accounts", "integer", 4, 6), Field("sum", "decimal", 10, 12, decimals=2), Field("rest", "text", 22, 9, required=False)), place="last")
RULES = (
    Rule("R1", 'credits == sumar("MOV", "amount", "number", number, "side", "C")', "record", "CTA"),
    Rule("R2", 'implica(type == "P", not vacio(due))', "record", "CTA"),
    Rule("R3", 'existe("CTA", "number", number)', "record", "MOV"),
    Rule("R4", 'valor("TOT", "accounts") == contar("CTA")', "file"),
    Rule("R5", 'abs(valor("TOT", "sum") - sumar("CTA", "credits")) <= 0.01', "file"),
    Rule("R6", 'due >= valor("CAB", "day")', "record", "CTA"),
)
BOOK = Layout("book", "fixed", (HEAD, ACCOUNT, MOVE, TOTAL), RULES, line_length=30, line_end="CRLF")
LINES = [
    "CAB20240115".ljust(30), "CTA000001" + "0000001500" + "P" + "20240301" + "  ", "CTA000002" + "0000000000" + "C" + " " * 10, "MOV000001" + "0000001000" + "C" + " " * 10,
    "MOV000001" + "0000000500" + "C" + " " * 10, "MOV000001" + "0000000700" + "D" + " " * 10, "TOT000002" + "000000001500" + " " * 9,
]


def frame(spark, lines):
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(lines)], "line long, value string")


def findings(spark, lines, layout=BOOK):
    parsed = parse_fixed(frame(spark, lines), layout)
    return {(r.origin, r.line, r.field, r.rule) for r in validate(parsed, layout, spark).collect()}


def test_clean_file_has_no_findings(spark):
    assert layout_problems(BOOK) == []
    assert findings(spark, LINES) == set()


@pytest.mark.parametrize(
    "change,expected",
    [
        ({1: "CTA000001" + "0000001501" + "P" + "20240301" + "  "}, {("rule", 2, None, "R1")}),
        ({1: "CTA000001" + "0000001500" + "P" + "        " + "  "}, {("rule", 2, None, "R2")}),
        ({1: "CTA000001" + "0000001500" + "X" + "20240301" + "  "}, {("field", 2, "type", None)}),
        ({1: "CTA000001" + "0000001500" + "P" + "20240230" + "  "}, {("field", 2, "due", None), ("rule", 2, None, "R2")}),
        ({1: "CTA000001" + "0000001500" + "P" + "20240101" + "  "}, {("rule", 2, None, "R6")}),
        ({3: "MOV000009" + "0000001000" + "C" + " " * 10}, {("rule", 2, None, "R1"), ("rule", 4, None, "R3")}),
        ({6: "TOT000003" + "000000001500" + " " * 9}, {("rule", None, None, "R4")}),
        ({6: "TOT000002" + "000000001502" + " " * 9}, {("rule", None, None, "R5")}),
        ({6: "TOT000002" + "000000001501" + " " * 9}, set()),
        ({5: "short"}, {("structure", 6, None, None)}),
        ({5: "ZZZ".ljust(30)}, {("structure", 6, None, None)}),
        ({6: "CTA000003" + "0000000000" + "C" + " " * 10}, {("occurrences", None, None, None), ("occurrences", 7, None, None)}),
    ],
)
def test_findings(spark, change, expected):
    assert findings(spark, [change.get(i, x) for i, x in enumerate(LINES)]) == expected


def test_null_operands_make_a_rule_not_applicable(spark):
    layout = Layout("n", "delimited", (Record("P", fields=(Field("a", "integer", length=5, required=False), Field("b", "integer", length=5, required=False))),), separator=";")
    parsed = parse_delimited(frame(spark, [";1", "1;", "2;1", "2;3"]), layout)
    broken = lambda text: {r._line for r in violations(Rule("x", text, "record", "P"), layout, parsed.frames, spark).collect()}
    assert broken("a > 5 and b > 5") == {2, 3, 4}
    assert broken("a > 1 or b > 5") == set()
    assert broken("a > 9 or b < 3") == {4}
    assert broken("implica(a > 1, b > 2)") == {3}
    assert broken("implica(b > 2, a > 5)") == {4}
    assert broken("1 < a <= 2") == {2}
    assert broken("a / (b - 1) > 9") == {4}
    assert broken("not vacio(a) and a not in [2]") == {1, 3, 4}


def test_compiler_matches_a_plain_evaluator(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["", *map(str, range(-3, 4))]), rng.choice(["", *map(str, range(-3, 4))])) for _ in range(40)]
    layout = Layout("n", "delimited", (Record("P", fields=(Field("a", "integer", length=5, required=False), Field("b", "integer", length=5, required=False))),), separator=";")
    parsed = parse_delimited(frame(spark, [";".join(r) for r in rows]), layout)

    class Missing(Exception):
        pass

    class Row(dict):
        def __missing__(self, name):
            raise Missing

    def plain(text, a, b):
        env = Row({"abs": abs, "implica": None} | {k: int(v) for k, v in (("a", a), ("b", b)) if v})
        try:
            return bool(eval(text, {"__builtins__": {}}, env))
        except (Missing, ZeroDivisionError):
            return None

    def expression(depth):
        if depth == 0:
            return f"{rng.choice(['a', 'b', 'a + b', 'a * 2 - b', 'abs(a)', 'a - -b'])} {rng.choice(['<', '<=', '==', '!=', '>', '>='])} {rng.choice(['b', '1', 'a', '0'])}"
        kind = rng.choice(["and", "or", "not"])
        return f"not ({expression(depth - 1)})" if kind == "not" else f"({expression(depth - 1)}) {kind} ({expression(depth - 1)})"

    for _ in range(12):
        text = expression(2)
        got = {r._line: r._result for r in evaluate(text, layout, "P", parsed.frames, spark).collect()}
        assert got == {i + 1: plain(text, *r) for i, r in enumerate(rows)}, text


@pytest.mark.parametrize("text", ["credits ==", "nothing > 1", "credits == type", 'sumar("XXX", "a")', 'contar("MOV", "side")', "credits", "__import__('os')", "credits.real > 1", 'valor("CTA", "credits") > 1', "type in credits"])
def test_rules_that_cannot_be(spark, text):
    assert check_rule(Rule("x", text, "record", "CTA"), BOOK)


def test_rule_hints(spark):
    with pytest.raises(RuleError, match="did you mean credits"):
        evaluate("credit > 1", BOOK, "CTA", {}, spark)


def test_round_trip_through_a_file(spark, tmp_path):
    path = str(tmp_path / "book")
    write_lines(frame(spark, LINES), path, BOOK)
    parsed = read_records(spark, path, BOOK)
    assert [r.value for r in read_lines(spark, path).orderBy("line").collect()] == LINES
    assert validate(parsed, BOOK, spark).count() == 0
    again = render_lines({k: v.drop("_errors") for k, v in parsed.frames.items()}, BOOK)
    assert [r.value for r in again.orderBy("line").collect()] == LINES and again.filter(F.size("errors") > 0).count() == 0
    rows = table_of(parsed, MOVE).orderBy("_pos").collect()
    assert [r.amount for r in rows] == ["10", "5", "7"]


def test_detect_layout(spark, tmp_path):
    path = str(tmp_path / "book")
    write_lines(frame(spark, LINES), path, BOOK)
    other = Layout("csv", "delimited", (Record("P", fields=(Field("a", "integer", length=3),)),), separator=";")
    assert detect_layout(spark, path, [other, BOOK]) == (BOOK, 1.0)


def test_completion(spark):
    parsed = parse_fixed(frame(spark, LINES), BOOK)
    frames = {k: v.drop("_errors") for k, v in parsed.frames.items()}
    frames["CTA"] = frames["CTA"].withColumn("credits", F.lit(None).cast("decimal(10,2)"))
    frames["TOT"] = frames["TOT"].withColumn("accounts", F.lit(None).cast("decimal(6,0)")).withColumn("sum", F.lit(None).cast("decimal(12,2)"))
    done = complete(frames, BOOK, spark)
    assert [r.value for r in render_lines(done, BOOK).orderBy("line").collect()] == LINES


def test_records_from_a_table(spark):
    t = spark.createDataFrame([("2", "15.000,00", "C"), ("3", "1,5", "D")], "n string, m string, s string").withColumn("_line", F.lit(1).cast("long"))
    rows = records_from(t, MOVE, {"number": "n", "amount": "m", "side": "s"}).orderBy("number").collect()
    assert [(r.kind, r.number, str(r.amount), r.rest) for r in rows] == [("MOV", "2", "15000.00", None), ("MOV", "3", "1.50", None)]


VALUES = [
    (Field("f", "decimal", 1, 6, decimals=2), "fixed", [("000150", "1.50", None), ("  0150", None, "digits"), ("      ", None, "missing")]),
    (Field("f", "integer", length=3), "delimited", [(" 12 ", "12", None), ("1.5", None, "whole"), ("-7", "-7", None), ("1234", None, "digits"), ("0012", "12", None)]),
    (Field("f", "decimal", length=5, decimals=2), "delimited", [("1.5", "1.50", None), ("1.555", None, "decimals"), ("x", None, "number"), ("1234.56", None, "digits")]),
    (Field("f", "date", length=10, date_mask="DD/MM/AAAA"), "delimited", [("29/02/2024", "2024-02-29", None), ("29/02/2023", None, "date"), ("1/2/2024", None, "date")]),
    (Field("f", "date", length=6, date_mask="AAAAMM"), "delimited", [("202402", "2024-02-01", None), ("202413", None, "date")]),
    (Field("f", "text", length=3, pattern="[A-Z]+"), "delimited", [("AB", "AB", None), ("Ab", None, "match"), ("ABCD", None, "length")]),
    (Field("f", "text", 1, 3, required=False), "fixed", [("A  ", "A", None), ("   ", None, None), (" A ", " A", None)]),
    (Field("f", "integer", length=2, allowed=("01", "02")), "delimited", [("1", "1", None), ("02", "2", None), ("3", None, "not one of")]),
    (Field("f", "constant", length=2, constant="P"), "delimited", [("P", "P", None), ("Q", None, "expected"), ("", None, "missing")]),
    (Field("f", "decimal", length=5, decimals=2), "delimited_fixed", [("001.50", "1.50", None), ("1.50", None, "width")]),
]


@pytest.mark.parametrize("field,mode,cases", VALUES)
def test_values(spark, field, mode, cases):
    df = spark.createDataFrame([(c[0],) for c in cases], "x string")
    value, error = parse(field, F.col("x"), mode)
    for row, (_, wanted, fault) in zip(df.select(value.alias("v"), error.alias("e")).collect(), cases):
        assert (None if row.v is None else str(row.v)) == wanted
        assert (row.e is None) == (fault is None) and (fault is None or fault in row.e)


def test_layout_problems():
    broken = layout_from(
        {"nombre": "x", "formato": "ancho_fijo", "longitud_registro": 10, "tipos_registro": [{"codigo": "1", "nombre": "r", "campos": [
            {"nombre": "a", "inicio": 1, "longitud": 3, "fin": 4, "tipo": "constante", "valor_constante": "1"}, {"nombre": "b", "inicio": 3, "longitud": 2, "tipo": "alfanumerico"}, {"nombre": "c", "inicio": 7, "longitud": 2, "tipo": "fecha", "formato_fecha": "QQ"}]}], "reglas": [{"id": "R", "descripcion": "", "ambito": "registro", "tipo_registro": "9", "expresion": "a"}]}
    )
    said = " ".join(layout_problems(broken))
    for part in ("end at 3, not 4", "before 4", "nothing stands at 5 to 6", "no part of a date", "lines have 10", "no record 9"):
        assert part in said


def test_masks():
    assert [java_date_format(m) for m in ("AAAAMMDD", "DD/MM/YYYY", "aaaa-mm")] == ["yyyyMMdd", "dd/MM/yyyy", "yyyy-MM"]
    for bad in ("DDMM", "AAAAAAAAMM", "AA-MM"):
        with pytest.raises(ValueError):
            java_date_format(bad)


def test_layouts_load_from_json_documents():
    document = {"nombre": "r", "formato": "xml", "etiqueta_raiz_xml": "Root", "tipos_registro": [{"codigo": "Op", "nombre": "o", "max_ocurrencias": None, "campos": [{"nombre": "amount", "tipo": "decimal", "decimales": 2, "etiqueta_xml": "Importe"}, {"nombre": "day", "tipo": "fecha", "formato_fecha": "AAAA-MM-DD", "obligatorio": False}]}]}
    layout = layout_from(json.loads(json.dumps(document)))
    assert layout.records[0].most is None and layout.records[0].fields[0].length == 18 and layout.records[0].fields[1].length == 10
    schema = xml_schema(layout)
    assert 'name="Importe"' in schema and 'fractionDigits value="2"' in schema and 'maxOccurs="unbounded"' in schema and 'type="xs:date" minOccurs="0"' in schema


def test_xml_round_trip(spark, tmp_path):
    op = Record("Op", fields=(Field("amount", "decimal", length=10, decimals=2, xml_tag="Amount"), Field("note", "text", length=20, required=False, xml_tag="Note")), most=None, xml_tag="Op")
    layout = Layout("x", "xml", (op,), root_tag="Root")
    data = spark.createDataFrame([(1, "10.50", "a < b"), (2, "3", None)], "_line long, a string, n string")
    body = render_xml({"Op": records_from(data, op, {"amount": "a", "note": "n"})}, layout).orderBy("line").collect()
    path = tmp_path / "x.xml"
    path.write_text("<Root>" + "".join(r.value for r in body) + "<Odd/></Root>")
    parsed = read_records(spark, str(path), layout)
    assert [(str(r.amount), r.note) for r in parsed.frames["Op"].orderBy("_line").collect()] == [("10.50", "a < b"), ("3.00", None)]
    assert [r.message for r in parsed.structure.collect()] == ["unknown element Odd"]


def test_date_difference(spark):
    parsed = parse_fixed(frame(spark, LINES), BOOK)
    got = evaluate('due - valor("CAB", "day")', BOOK, "CTA", parsed.frames, spark).orderBy("_line").collect()
    assert [r._result for r in got] == [(datetime.date(2024, 3, 1) - datetime.date(2024, 1, 15)).days, None]
