import json

from cotejo.__main__ import main

#: A small layout in the documents' own words.
DOCUMENT = {
    "nombre": "small", "formato": "ancho_fijo", "longitud_registro": 12, "tipos_registro": [
        {"codigo": "01", "nombre": "d", "max_ocurrencias": None, "campos": [{"nombre": "kind", "inicio": 1, "longitud": 2, "tipo": "constante", "valor_constante": "01"}, {"nombre": "amount", "inicio": 3, "longitud": 10, "tipo": "decimal", "decimales": 2}]},
        {"codigo": "09", "nombre": "t", "posicion": "ultimo", "campos": [{"nombre": "kind", "inicio": 1, "longitud": 2, "tipo": "constante", "valor_constante": "09"}, {"nombre": "total", "inicio": 3, "longitud": 10, "tipo": "decimal", "decimales": 2}]},
    ], "reglas": [{"id": "R1", "descripcion": "total", "ambito": "archivo", "expresion": 'valor("09", "total") == sumar("01", "amount")'}],
}


def test_layout_commands(spark, tmp_path, capsys):
    layout = tmp_path / "l.json"
    layout.write_text(json.dumps(DOCUMENT))
    assert main(["check", str(layout)]) == 0
    assert main(["synthesise", str(layout), str(tmp_path / "file"), "--rows", "5", "--seed", "3"]) == 0
    assert main(["validate", str(layout), str(tmp_path / "file")]) == 0
    (tmp_path / "bad.txt").write_text("010000000100\n090000000200\n")
    assert main(["validate", str(layout), str(tmp_path / "bad.txt")]) == 1
    assert "error rule R1 total" in capsys.readouterr().out


def test_pair_command(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("comprobante,importe\n" + "".join(f"{i:05d},{i}.00\n" for i in range(1, 30)))
    (tmp_path / "b.csv").write_text("numero_comprobante;importe\n" + "".join(f"{i};{i + (i == 7)},00\n" for i in range(2, 31)))
    assert main(["pair", str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), "--out", str(tmp_path / "out")]) == 0
    said = capsys.readouterr().out
    assert "only in A: 1" in said and "in both, different: 1" in said and "in both, equal: 27" in said
    assert [r.key for r in spark.read.parquet(str(tmp_path / "out" / "differences")).collect()] == ["7"]
