"""Record files from typed rows: completion by rules, rendering, schema of XML files."""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.spec.layout import Field, Layout, Record
from cotejo.spec.rules import ABSOLUTE, VALUE, RuleError, evaluate, parse_rule
from cotejo.spec.values import coerce, render

PASSES = 4


def records_from(table: DataFrame, record: Record, mapping: dict[str, str], line: str = "_line") -> DataFrame:
    """A table's columns as a record type's typed fields; mapping: field to column. Fields without a column are empty."""
    cells = []
    for f in record.fields:
        if f.name in mapping:
            cells.append(coerce(f, F.col(mapping[f.name]).cast("string")).cast(f.spark_type).alias(f.name))
        else:
            cells.append(F.lit(f.constant if f.kind == "constant" else None).cast(f.spark_type).alias(f.name))
    return table.select(F.col(line).alias("_line"), *cells)


def _solvable(text: str, layout: Layout, record: str | None) -> list[tuple[str, str, str]]:
    """(record, field, expression) for each side of an equality, or of abs(a - b) <= t, that is a field by itself."""
    node = parse_rule(text)
    if isinstance(node, ast.Compare) and len(node.ops) == 1:
        left, right = node.left, node.comparators[0]
        if isinstance(node.ops[0], ast.LtE) and isinstance(left, ast.Call) and getattr(left.func, "id", "") == ABSOLUTE and isinstance(left.args[0], ast.BinOp) and isinstance(left.args[0].op, ast.Sub):
            left, right = left.args[0].left, left.args[0].right
        elif not isinstance(node.ops[0], ast.Eq):
            return []
        out = []
        for a, b in ((left, right), (right, left)):
            if isinstance(a, ast.Name) and record:
                out.append((record, a.id, ast.unparse(b)))
            elif isinstance(a, ast.Call) and getattr(a.func, "id", "") == VALUE and len(a.args) == 2:
                out.append((str(a.args[0].value), str(a.args[1].value), ast.unparse(b)))
        return out
    return []


def complete(frames: dict[str, DataFrame], layout: Layout, spark: SparkSession) -> dict[str, DataFrame]:
    """frames with empty fields filled from equality rules: record rules, then file rules, then record rules again, until
    nothing new can be solved. Given values are never changed. Plans stay lazy; which field a rule solves is known from the
    layout, so each solvable field is filled once per phase, in the order of its dependencies."""
    done = dict(frames)
    plan = [(r, s) for r in layout.rules for s in _solvable(r.expression, layout, r.record if r.scope == "record" else None)]
    filled: set[tuple[str, str]] = set()
    for _ in range(PASSES):
        new = 0
        for rule, (code, name, text) in plan:
            record = layout.record(code)
            f = record.field(name) if record else None
            if f is None or f.kind == "constant" or (code, name) in filled:
                continue
            needs = {n.id for n in ast.walk(ast.parse(text, mode="eval")) if isinstance(n, ast.Name)} & {x.name for x in record.fields}
            waits = {(code, n) for n in needs} & {(c, n) for _, (c, n, _) in plan} - filled - {(code, name)}
            if waits and new == 0 and _ < PASSES - 1:
                continue
            own = rule.scope == "record"
            try:
                if own:
                    df = evaluate(text, layout, code, done, spark, "_solved")
                else:
                    one = F.broadcast(evaluate(text, layout, None, done, spark, "_solved").select(F.lit(1).alias("_one"), "_solved"))
                    df = done[code].withColumn("_one", F.lit(1)).join(one, "_one", "left").drop("_one")
            except RuleError:
                continue
            solved = F.round("_solved", f.decimals if f.kind == "decimal" else 0) if f.kind in ("integer", "decimal") else F.col("_solved")
            empty = F.col(name).isNull() if f.kind in ("integer", "decimal", "date") else F.col(name).isNull() | (F.trim(name) == "")
            done[code] = df.withColumn(name, F.when(empty, solved.cast(f.spark_type)).otherwise(F.col(name))).drop("_solved")
            filled.add((code, name))
            new += 1
        if not new:
            break
    return done


def render_lines(frames: dict[str, DataFrame], layout: Layout) -> DataFrame:
    """(line, code, value, errors) of fixed-width or delimited records; the first record types come first unless _line says
    otherwise."""
    out = []
    for r in layout.records:
        if r.code not in frames:
            continue
        cells, errors = [], []
        ordered = sorted(r.fields, key=lambda f: f.start or 0) if layout.format == "fixed" else r.fields
        for f in ordered:
            text, error = render(f, F.col(f.name), layout.mode)
            cells.append(F.coalesce(text, F.lit("")))
            errors.append(error)
            if layout.format == "delimited":
                errors.append(F.when(cells[-1].contains(layout.separator or ";"), F.lit(f"{f.name} holds the separator")))
        value = F.concat(*cells) if layout.format == "fixed" else F.concat_ws(layout.separator or ";", *cells)
        if layout.format == "fixed" and layout.line_length:
            errors.append(F.when(F.length(value) != layout.line_length, F.lit(f"the line has not {layout.line_length} characters")))
        out.append(frames[r.code].select(F.col("_line").alias("line"), F.lit(r.code).alias("code"), value.alias("value"), F.filter(F.array(*errors), lambda e: e.isNotNull()).alias("errors")))
    return reduce(lambda a, b: a.unionByName(b), out)


def write_lines(lines: DataFrame, path: str, layout: Layout, files: int = 1) -> None:
    """Ordered text files with the layout's line ends; more than one file splits the order by ranges."""
    ordered = lines.repartitionByRange(files, "line").sortWithinPartitions("line")
    ordered.select("value").write.mode("overwrite").option("lineSep", layout.eol).option("encoding", {"latin-1": "ISO-8859-1"}.get(layout.encoding, layout.encoding)).text(path)


def render_xml(frames: dict[str, DataFrame], layout: Layout) -> DataFrame:
    """(line, code, value, errors): value is a record's element; empty optional fields are left out."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    out = []
    for r in layout.records:
        if r.code not in frames:
            continue
        cells, errors = [], []
        for f in r.fields:
            text, error = render(f, F.col(f.name), "xml")
            tag = f.xml_tag or f.name
            cells.append(F.when(text.isNotNull(), F.concat(F.lit(f"<{tag}>"), escape(text), F.lit(f"</{tag}>"))).otherwise(F.lit("")))
            errors.append(error)
        tag = r.xml_tag or r.code
        out.append(frames[r.code].select(F.col("_line").alias("line"), F.lit(r.code).alias("code"), F.concat(F.lit(f"<{tag}>"), *cells, F.lit(f"</{tag}>")).alias("value"), F.filter(F.array(*errors), lambda e: e.isNotNull()).alias("errors")))
    return reduce(lambda a, b: a.unionByName(b), out)


def _xsd_type(f: Field) -> str:
    base = {"integer": "xs:integer", "decimal": "xs:decimal", "date": "xs:date", "text": "xs:string", "constant": "xs:string"}[f.kind]
    if f.kind == "date":
        return "xs:date" if "DD" in (f.date_mask or "").upper() else "xs:gYearMonth"
    limits = []
    if f.kind == "constant":
        limits.append(f'<xs:enumeration value="{f.constant}"/>')
    limits += [f'<xs:enumeration value="{a}"/>' for a in f.allowed or ()]
    if f.pattern:
        limits.append(f'<xs:pattern value="{f.pattern}"/>')
    if f.kind in ("integer", "decimal") and f.length:
        limits.append(f'<xs:totalDigits value="{f.length}"/>')
    if f.kind == "decimal":
        limits.append(f'<xs:fractionDigits value="{f.decimals}"/>')
    if f.kind == "text" and f.length:
        limits.append(f'<xs:maxLength value="{f.length}"/>')
    return f'<xs:simpleType><xs:restriction base="{base}">{"".join(limits)}</xs:restriction></xs:simpleType>'


def xml_schema(layout: Layout) -> str:
    """The XSD of an XML layout: occurrences, digits, enumerations, patterns, lengths, dates."""
    parts = []
    for r in layout.records:
        cells = []
        for f in r.fields:
            kind, least = _xsd_type(f), "" if f.required else ' minOccurs="0"'
            tag = f.xml_tag or f.name
            cells.append(f'<xs:element name="{tag}" type="{kind}"{least}/>' if kind.startswith("xs:") else f'<xs:element name="{tag}"{least}>{kind}</xs:element>')
        most = "unbounded" if r.most is None else r.most
        parts.append(f'<xs:element name="{r.xml_tag or r.code}" minOccurs="{r.least}" maxOccurs="{most}"><xs:complexType><xs:sequence>{"".join(cells)}</xs:sequence></xs:complexType></xs:element>')
    return f'<?xml version="1.0" encoding="UTF-8"?><xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="{layout.root_tag}"><xs:complexType><xs:sequence>{"".join(parts)}</xs:sequence></xs:complexType></xs:element></xs:schema>'
