import json

from pyspark.sql import functions as F

from cotejo.operators.configure import Scripted, check_configuration, configure_from_text, groups_from_dict, groups_to_dict, json_in, tolerance_in
from cotejo.operators.filters import Filter
from cotejo.operators.reconcile import Group, GroupFile, reconcile
from cotejo.operators.store import Store
from cotejo.operators.totals import Term, Threshold, Totals
from cotejo.spec.evidence import closest_phrase, declared_separator, is_supported, looks_fragmented
from cotejo.spec.readers import parse_fixed
from cotejo.spec.synthesis import sample_pattern, synthesise
from cotejo.spec.validate import validate
from cotejo.spec.writers import render_lines
from tests.test_spec import BOOK, Layout, Record, Rule


def tables(spark):
    a = spark.createDataFrame([(f"00{i}", str(i * 10), "OK" if i % 10 else "ANULADO", i) for i in range(1, 31)], "id string, m string, estado string, _pos long")
    b = spark.createDataFrame([(f"{i}", str(i * 10), i) for i in range(1, 31)], "ref string, v string, _pos long")
    return [("a", 0, a), ("b", 1, b)]


def test_proposals_are_checked(spark):
    proposed = {
        "files": [
            {"id": "a", "key": ["id", "nope"], "form": "exact", "filters": [{"column": "estado", "operator": "!=", "values": ["ANULADO", "gone"]}, {"column": "zz", "operator": "=="}, {"column": "m", "operator": "~"}]},
            {"id": "b", "key": "ref"}, {"id": "ghost"},
        ],
        "compare": [["m", "v"], ["estado", "v"], ["m", "zz"]], "tolerance": "x",
    }
    done = check_configuration(proposed, tables(spark), "con tolerancia de 5 centavos")
    assert done.invented == 4 and done.mended == 3
    assert done.config["groups"][0]["files"][0]["filters"][0]["operator"] == "=="
    assert {f["form"] for g in done.config["groups"] for f in g["files"]} <= {"digits", "no_zeros"}
    assert done.config["compare"] == [["m", "v"]] and done.config["tolerance"] == "0.05"
    groups, compare, functions, tolerance = groups_from_dict(done.config, [[tables(spark)[0][2]], [tables(spark)[1][2]]])
    s = reconcile(groups, compare, tolerance, functions).summary().first()
    assert (s.in_all, s.in_all_diff, s.only_in_group2) == (27, 0, 3)


def test_configurations_survive_json(spark):
    t = tables(spark)
    totals = Totals((Term("m"),), ("estado",), condition="single", thresholds=(Threshold(">", 1),))
    groups = [Group("A", (GroupFile("a", t[0][2], ("id",), "digits", (Filter("estado", "==", ("ANULADO",), as_numbers=False),), totals),)), Group("B", (GroupFile("b", t[1][2], ("ref",), "digits"),))]
    again, compare, functions, tolerance = groups_from_dict(json.loads(json.dumps(groups_to_dict(groups, [("m", "v")]))), [[t[0][2]], [t[1][2]]])
    assert again[0].files[0].totals == totals and again[0].files[0].filters == groups[0].files[0].filters and (compare, functions, tolerance) == ([("m", "v")], [], 0.01)


def test_text_to_configuration(spark):
    answer = 'Sure: {"files": [{"id": "a", "key": ["id"], "form": "no_zeros"}, {"id": "b", "key": ["ref"], "form": "no_zeros"}], "compare": [["m", "v"]]} done'
    provider = Scripted([answer, "nothing"])
    assert configure_from_text(provider, "cruzar por id", tables(spark)).config["compare"] == [["m", "v"]]
    assert configure_from_text(provider, "cruzar", tables(spark)).config is None and "estado: ANULADO, OK" in provider.asked[0]
    assert json_in("a {b {c} d} e") == "{b {c} d}"


def test_tolerances():
    for text, value in (("tolerancia 1", "1"), ("diferencias de hasta 2,5 pesos", "2.5"), ("até 10 centavos", "0.1"), ("un centavo", "0.01"), ("cruzar todo", None)):
        got = tolerance_in(text)
        assert (None if got is None else str(got.normalize())) == value


def test_store(tmp_path):
    s = Store(tmp_path)
    run = s.save("june", {"groups": []}, {"n": 1})
    assert s.get(run)["name"] == "june" and [r["id"] for r in s.list_runs()] == [run] and s.list_runs("other") == [] and s.get("../x") is None
    s.delete(run)
    assert s.get(run) is None
    for config in ({"groups": [{"name": "a", "files": []}]}, {"groups": [{"name": "b", "files": []}]}, {"groups": []}):
        entry = s.remember("sig", config)
    assert (entry["used"], entry["corrected"], s.confidence("sig"), s.confidence("new")) == (3, 1, 60, 50)
    assert not s.consent("u")
    s.set_consent("u", True)
    s.add_key_examples("u", [{"i": i} for i in range(250)])
    assert s.consent("u") and len(s.key_examples("u")) == 200 and s.key_examples("u")[0]["i"] == 50
    s.save_layout("l", {"nombre": "x"})
    assert s.layouts() == {"l": {"nombre": "x"}}


def test_evidence():
    manual = "# Registro\nEl importe debe ser mayor que cero.\n| Fecha | 3 | 8 | AAAAMMDD |\nLos campos están delimitados por punto y coma."
    assert is_supported("El importe debe ser **mayor** que cero", manual) and is_supported("Fecha | 8 | AAAAMMDD", manual) and is_supported("El importe debe ser mayor que cero ya", manual)
    assert not is_supported("El saldo final coincide con la cuenta", manual) and not is_supported("x", manual)
    assert closest_phrase("importe mayor a cero", manual) == "El importe debe ser mayor que cero." and declared_separator(manual) == ";"
    assert looks_fragmented("a\nb\nc d") and not looks_fragmented("a b\nc d")


def test_synthetic_files_are_valid(spark):
    layout = Layout("book", "fixed", tuple(BOOK.records), (Rule("R4", 'valor("TOT", "accounts") == contar("CTA")', "file"), Rule("R5", 'valor("TOT", "sum") == sumar("CTA", "credits")', "file")), line_length=30)
    for seed in (0, 1):
        lines = render_lines(synthesise(spark, layout, 50, seed), layout)
        assert lines.filter(F.size("errors") > 0).count() == 0 and lines.count() == 102
        parsed = parse_fixed(lines.select("line", "value"), layout)
        assert validate(parsed, layout, spark).collect() == []


def test_patterns():
    import random
    import re

    for pattern in (r"\d{11}", "[A-C]{2}-(X|Y)[0-9]+", "a?b*c"):
        assert re.fullmatch(pattern, sample_pattern(pattern, random.Random(1)))
    assert Record("x").identifier is None
