import json

import pytest
from pyspark.sql import functions as F

from cotejo.operators.configure import Scripted
from cotejo.operators.key_provider import propose_keys, propose_pair_key
from cotejo.plans import cases
from cotejo.sources.tables import read_csv, write_tables


@pytest.mark.parametrize("locale", cases.LOCALES)
def test_cases_and_ablations(spark, locale):
    """The complete configuration is right on every key; without key form, filter or tolerance it is not."""
    case = cases.make_case(spark, 400, 7, locale)
    right = lambda **x: cases.accuracy(case, cases.run_case(case, **x)).first()
    whole = right()
    assert (whole.right, whole.total) == (400, 400) and cases.key_found(case)
    assert right(form="exact").right < 100 and right(exclude=False).right < 400 and right(tolerance=5.0).right < 400
    again = cases.make_case(spark, 400, 7, locale)
    assert case.bank.exceptAll(again.bank).isEmpty()
    with pytest.raises(ValueError):
        cases.make_case(spark, 1, 1, "xx")


def key_tables(spark):
    a = spark.range(1, 61).select(F.format_string("F%05d", "id").alias("factura"), (F.col("id") % 3).cast("string").alias("sucursal"), F.lit("x").alias("nota"))
    b = spark.range(1, 51).select(F.col("id").cast("string").alias("ref"), (F.col("id") % 3).cast("string").alias("suc"))
    return a, b


def test_proposed_keys_are_checked_and_cut(spark):
    a, b = key_tables(spark)
    provider = Scripted([json.dumps({"keys": [["factura", "nope"], ["ref", "suc"]]}), "so: " + json.dumps({"keys": [["factura", "sucursal"], ["ref", "suc"]], "form": "exact"})])
    done = propose_keys(provider, [a, b])
    assert done.found.keys == (("factura",), ("ref",)) and done.found.form == "digits" and done.found.strength == 1.0
    assert (done.invented, done.rounds) == (1, 2) and "nope" in provider.asked[1] and "F00001" in provider.asked[0]


def test_weak_proposals_are_refused(spark):
    a, b = key_tables(spark)
    weak = Scripted([json.dumps({"keys": ["sucursal", "suc"]}), "nothing"])
    done = propose_pair_key(weak, a, b, samples=0)
    assert done.found is None and done.rounds == 2 and len(done.notes) == 2 and "F00001" not in weak.asked[0]


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,plain\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,note\n1,one\n2,plain\n", encoding="utf-8")
    assert [(r.id, r.note) for r in read_csv(spark, str(tmp_path / "a.csv")).orderBy("_pos").collect()] == [("1", "two\nlines"), ("2", "plain")]
    assert read_csv(spark, str(tmp_path / "b.csv")).count() == 2


def test_folders_hold_all_rows(spark, tmp_path):
    notes = write_tables({"all": spark.range(200_001)}, str(tmp_path / "out")).first()
    assert (notes.n_rows, notes.written) == (200_001, 200_001) and spark.read.parquet(str(tmp_path / "out/all")).count() == 200_001
    assert write_tables({"some": spark.range(10)}, str(tmp_path / "cut"), limit=3).first().written == 3
