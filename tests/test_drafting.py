import json

from cotejo.operators.configure import Scripted
from cotejo.spec.drafting import draft, draft_from_tables, execution_problems, markdown_tables
from cotejo.spec.layout import layout_from, layout_problems

MANUAL = """# Archivo
Cada linea tiene 20 caracteres.

## Cabecera
| Campo | Desde | Hasta | Longitud | Tipo | Observaciones |
|---|---|---|---|---|---|
| Tipo de registro | 1 | 2 | 2 | N | Valor fijo "01" |
| Fecha | 3 | 10 | 8 | Fecha | Formato AAAAMMDD |
| Relleno | 11 | 20 | 10 | A | blancos |

## Detalle de operaciones
| Campo | Desde | Hasta | Longitud | Tipo | Observaciones |
|---|---|---|---|---|---|
| Tipo de registro | 1 | 2 | 2 | N | Valor fijo "02" |
| Importe | 3 | 12 | 10 | N | con 2 decimales |
| Cuenta | 13 | 20 | 8 | A | |
"""


def test_tables_become_a_layout(spark):
    assert [len(rows) for _, rows in markdown_tables(MANUAL)] == [4, 4]
    document = draft_from_tables(MANUAL)
    layout = layout_from(document)
    assert layout_problems(layout) == [] and layout.line_length == 20 and layout.record("02").most is None
    kinds = {f.name: (f.kind, f.decimals) for r in layout.records for f in r.fields}
    assert kinds["importe"] == ("decimal", 2) and kinds["fecha"][0] == "date" and kinds["tipo_de_registro"][0] == "constant"
    assert execution_problems(layout, spark) == []


def test_answers_are_checked_and_sent_back(spark):
    good = draft_from_tables(MANUAL)
    bad = json.loads(json.dumps(good))
    bad["tipos_registro"][1]["campos"][1]["longitud"] = 9
    provider = Scripted(["no object", f"Here: {json.dumps(bad)}", json.dumps(good)])
    done = draft(provider, MANUAL, spark)
    assert done.rounds == 2 and done.problems  # two faults are no fewer than one: no progress
    done = draft(Scripted([json.dumps(bad), json.dumps(good)]), MANUAL, spark)
    assert done.problems == [] and done.rounds == 2 and done.layout.record("02") is not None


def test_invented_evidence_is_told(spark):
    document = draft_from_tables(MANUAL)
    document["tipos_registro"][0]["campos"][1]["evidencia"] = "La moneda se informa según la tabla ISO vigente"
    done = draft(Scripted([json.dumps(document)]), MANUAL, spark, rounds=1)
    assert any("the manual does not say so" in p for p in done.problems)
