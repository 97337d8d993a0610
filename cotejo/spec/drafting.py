"""Layouts drafted from manuals: from their tables alone, or by a provider whose answers are checked and sent back."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cotejo.functions.text import fold_name, snake_name
from cotejo.operators.configure import Provider, json_in
from cotejo.spec.evidence import declared_separator, unsupported
from cotejo.spec.layout import Layout, layout_from, layout_problems
from cotejo.spec.readers import parse_delimited, parse_fixed
from cotejo.spec.synthesis import synthesise
from cotejo.spec.validate import validate
from cotejo.spec.writers import render_lines

ROUNDS = 4
#: Beginnings of the table headings of Spanish manuals, folded, by what the column holds.
_HEADINGS = {
    "nombre": ("campo", "nombre", "dato", "descripcion"), "inicio": ("inicio", "desde", "posicioninicial", "pos"), "fin": ("fin", "hasta", "posicionfinal"), "longitud": ("long", "largo", "tamano"),
    "tipo": ("tipo", "formato"), "obligatorio": ("oblig", "requerido"), "nota": ("observ", "nota", "valor", "contenido"),
}


def markdown_tables(manual: str) -> list[tuple[str, list[list[str]]]]:
    """(heading above, rows of cells) of every pipe table."""
    found, heading, rows = [], "", []
    for line in [*manual.splitlines(), ""]:
        text = line.strip()
        if text.startswith("|"):
            cells = [c.strip() for c in text.strip("|").split("|")]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                rows.append(cells)
            continue
        if rows:
            found.append((heading, rows))
            rows = []
        if text.startswith("#"):
            heading = text.lstrip("#").strip()
    return found


def _kind(told: str, note: str) -> dict:
    low, all_of = fold_name(told), f"{told} {note}"
    mask = re.search(r"\b(?:(?:AAAA|YYYY)[-/.]?MM(?:[-/.]?DD)?|DD[-/.]?MM[-/.]?(?:AAAA|YYYY))\b", all_of.upper())
    picture = re.search(r"9\((\d+)\)\s*V\s*(9+|9\((\d+)\))", all_of, re.I)
    constant = re.search(r"(?:valor fijo|constante|fijo)\s*:?\s*[\"'“]([^\"'”]+)[\"'”]", all_of, re.I)
    if constant:
        return {"tipo": "constante", "valor_constante": constant[1]}
    if mask:
        return {"tipo": "fecha", "formato_fecha": mask[0]}
    places = re.search(r"(\d+)\s*decimal", all_of, re.I)
    if picture or places or low.startswith(("decimal", "importe")):
        return {"tipo": "decimal", "decimales": int(picture[3] or len(picture[2])) if picture else int(places[1]) if places else 2}
    return {"tipo": "numerico"} if low in ("n", "num", "numerico", "entero") else {"tipo": "alfanumerico"}


def draft_from_tables(manual: str, name: str = "draft") -> dict:
    """A layout document from the manual's field tables, without any model: one record type per table."""
    records = []
    for heading, rows in markdown_tables(manual):
        header = [fold_name(c) for c in rows[0]]
        at: dict[str, int] = {}
        for what, words in _HEADINGS.items():
            for i, h in enumerate(header):
                if i not in at.values() and h.startswith(words):
                    at[what] = i
                    break
        if "nombre" not in at or not ({"longitud", "fin"} & set(at)):
            continue
        fields, taken = [], set()
        for row in rows[1:]:
            cell = lambda what: row[at[what]] if what in at and at[what] < len(row) else ""  # noqa: B023, E731
            numbers = {k: int(m[0]) for k in ("inicio", "fin", "longitud") if (m := re.search(r"\d+", cell(k)))}
            own = snake_name(cell("nombre"))
            while own in taken:
                own += "_2"
            taken.add(own)
            f = {"nombre": own, "descripcion": cell("nombre"), "evidencia": " | ".join(row), "obligatorio": not fold_name(cell("obligatorio")).startswith("n"), **numbers, **_kind(cell("tipo"), cell("nota"))}
            fields.append(f)
        code = next((f["valor_constante"] for f in fields if f["tipo"] == "constante"), snake_name(heading))
        records.append({"codigo": code, "nombre": heading, "max_ocurrencias": None if re.search("detalle|movimiento|operaci", heading, re.I) else 1, "campos": fields})
    separator = declared_separator(manual)
    ends = [max((f.get("inicio", 0) + f.get("longitud", 0) - 1 for f in r["campos"]), default=0) for r in records]
    fixed = {"formato": "ancho_fijo", "longitud_registro": max(ends)} if ends and separator is None else {"formato": "delimitado", "separador_campos": separator or ";"}
    return {"nombre": name, "separador_lineas": "CRLF" if re.search("CRLF|retorno de carro", manual, re.I) else "LF", "tipos_registro": records, "reglas": [], **fixed}


def execution_problems(layout: Layout, spark: SparkSession, seeds: tuple[int, ...] = (0, 1)) -> list[str]:
    """What stands between a layout and its own synthetic files: they must be written, read and validated without findings."""
    said = []
    for seed in seeds:
        lines = render_lines(synthesise(spark, layout, 3, seed), layout)
        said += [f"{r.code}: {e}" for r in lines.filter(F.size("errors") > 0).limit(5).collect() for e in r.errors]
        parsed = (parse_fixed if layout.format == "fixed" else parse_delimited)(lines.select("line", "value"), layout)
        said += [f"{r.origin} {r.record_type or ''} {r.field or r.rule or ''}: {r.message}" for r in validate(parsed, layout, spark).limit(10).collect()]
    return list(dict.fromkeys(said))


@dataclass
class Draft:
    layout: Layout | None
    problems: list[str]
    rounds: int
    history: list[int] = field(default_factory=list)


def verify(document: dict, manual: str, spark: SparkSession) -> tuple[Layout | None, list[str]]:
    """(layout, problems): shape, then layout and rules, then evidence, then execution."""
    try:
        layout = layout_from(document)
        problems = layout_problems(layout)
    except (TypeError, KeyError, ValueError, AttributeError) as e:
        return None, [f"the document is no layout: {e}"]
    problems += [f"{what}: the manual does not say so; it says: {near}" for what, near in unsupported(layout, manual)]
    if not problems and layout.format != "xml":
        problems = execution_problems(layout, spark)
    return layout, problems


def draft(provider: Provider, manual: str, spark: SparkSession, rounds: int = ROUNDS) -> Draft:
    """Ask, verify, send the problems back; stop when there are none, when they stop shrinking, or after `rounds`. The best
    layout so far is kept."""
    best, said, history = None, None, []
    prompt = f"Describe the file of this manual as a JSON layout.\n{manual}\nA first draft from its tables:\n{json.dumps(draft_from_tables(manual), ensure_ascii=False)}"
    for turn in range(1, rounds + 1):
        try:
            layout, problems = verify(json.loads(json_in(provider.complete(prompt))), manual, spark)
        except ValueError as e:
            layout, problems = None, [str(e)]
        history.append(len(problems))
        if said is None or (layout is not None and (best is None or len(problems) < len(said))):
            best, said = layout, problems
        if not problems or (turn > 1 and history[-1] >= history[-2]):
            break
        prompt = "Mend the layout. Problems:\n" + "\n".join(f"- {p}" for p in problems)
    return Draft(best, said or [], len(history), history)
