import zipfile

import pytest
from pyspark.sql import functions as F

from cotejo.operators.key_model import FEATURES, KeyModel, candidates, suggest_keys_by_model, syllables
from cotejo.operators.usage import append_events, columns_differ, confidence, memory_mode, read_events, same_configuration, signature, summary
from cotejo.sources.tables import header_row, read_csv, read_csv_zip, sniff_encoding, sniff_separator, table_from_grid, write_tables, zip_member
from cotejo.streaming.events import event_stream, running_totals


@pytest.mark.parametrize("separator", [",", ";", "|", "\t"])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_csv_dialects(spark, tmp_path, separator, encoding):
    path = tmp_path / "a.csv"
    text = "\n".join(separator.join(r) for r in [["año", "monto", "nota"], ["2024", "1.5", "NA"], ["2025", "", "ñandú"]])
    path.write_bytes(text.encode(encoding))
    df = read_csv(spark, str(path))
    assert df.columns == ["año", "monto", "nota", "_pos"]
    assert [tuple(r)[:3] for r in df.orderBy("_pos").collect()] == [("2024", "1.5", None), ("2025", None, "ñandú")]


def test_sniffing():
    assert sniff_separator(b"a;b\n1;2\n3;4\n") == ";" and sniff_separator(b"one\ntwo\n") == ","
    assert sniff_encoding("ñ".encode()) == "utf-8" and sniff_encoding("ñ".encode("latin-1")) == "ISO-8859-1"


def test_zipped_csv(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("data.csv", "a,b\n1,2\n")
        z.writestr("__MACOSX/._data.csv", "x")
    assert [tuple(r)[:2] for r in read_csv_zip(spark, str(path), str(tmp_path)).collect()] == [("1", "2")]
    with pytest.raises(ValueError):
        zip_member(["a.csv", "b.csv"])


def test_grids(spark):
    grid = [["Report", None, None], [None, None, None], ["id", "name", "name"], ["1", "a", None], [None, None, None], ["2", "b", "c"]]
    assert header_row(grid) == 2
    df = table_from_grid(spark, grid)
    assert df.columns == ["id", "name", "name (2)", "_pos"] and df.count() == 2


def test_written_tables_are_cut_and_noted(spark, tmp_path):
    notes = write_tables({"m": spark.range(10).select("id")}, str(tmp_path), 3, order={"m": ["id"]})
    assert tuple(notes.first()) == ("m", 10, 3)
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/m").orderBy("id").collect()] == [0, 1, 2]


def test_signature_and_memory(spark):
    assert signature([[["Año", "id"], ["_x", "b"]]]) == signature([[["ID", "ano"], ["B"]]]) != signature([[["id"]]])
    df = spark.createDataFrame([(30, 0), (2, 1), (0, 0), (1, 5)], "u int, c int")
    assert [r[0] for r in df.select(confidence(F.col("u"), F.col("c"))).collect()] == [97, 50, 50, 0]
    modes = spark.createDataFrame([(False, 99, True), (True, 96, True), (True, 96, False), (True, 95, True)], "k boolean, t int, c boolean")
    assert [r[0] for r in modes.select(memory_mode(F.col("k"), F.col("t"), F.col("c"))).collect()] == ["nothing", "automatic", "offer_auto", "offer"]
    a = {"groups": [{"name": "x", "files": [{"name": "f", "key": ["id"]}]}], "sheets": ["s"]}
    b = {"groups": [{"name": "y", "files": [{"name": "g", "key": ["id"]}]}]}
    assert same_configuration(a, b) and not same_configuration(a, {"groups": []})
    assert columns_differ(["a", "b", "c"], ["x", "y"]) and not columns_differ(["Año", "b"], ["ano", "b"])


def test_event_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("u1", "s", "memoria", True), ("u1", "s", "heuristica", False), ("u2", "t", "memoria_auto", False)]
    append_events(spark.createDataFrame(rows, "usuario_id string, firma_archivos string, origen string, corregida boolean"), path)
    with open(f"{path}/part-x.json", "w") as f:
        f.write("{broken\n")
    got = summary(read_events(spark, path)).first()
    assert (got.runs, got.users, got.learned, got.accepted, got.automatic) == (3, 2, 2, 1, 1)
    stream = running_totals(event_stream(spark, path)).writeStream.format("memory").queryName("totals").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    stream.processAllAvailable()
    stream.stop()
    assert {(r.signature, r.used, r.corrected) for r in spark.table("totals").collect() if r.signature} == {("s", 2, 1), ("t", 1, 0)}


def test_learned_keys(spark):
    a = spark.range(60).select(F.format_string("F%05d", F.col("id") * 7 + 100).alias("nro_factura"), (F.col("id") + 1).cast("string").alias("fila"))
    b = spark.range(60).select(F.format_string("%05d", F.col("id") * 7 + 100).alias("comprobante"), (F.col("id") + 1).cast("string").alias("linea"))
    found = candidates([a, b])
    assert found and all(len(c.features) == len(FEATURES) for c in found)
    model = KeyModel.fit(spark, [(c.features, c.column == "comprobante") for c in found])
    assert [k.column for k in suggest_keys_by_model([a, b], model)] == ["nro_factura", "comprobante"]
    assert syllables("Id Cliente-2") == ["id", "cli"]
