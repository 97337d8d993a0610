"""The rule language, compiled to Column expressions and joins.

Python's expression grammar is parsed, checked against the layout's types, and compiled; nothing is ever evaluated as Python.
Aggregates over another record type become one group-by joined on their correlated filters, so a rule is linear in the file
where a record-by-record evaluation would be quadratic.

A null operand makes a rule not applicable, in reading order: `null and false` is not applicable, though SQL calls it false.
"""

from __future__ import annotations

import ast
import difflib
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions.text import strip
from cotejo.spec.layout import Layout, Record, Rule

#: Function names of the language.
IMPLIES, EMPTY, ABSOLUTE, ROUND, LENGTH, COUNT, SUM, VALUE, EXISTS = "implica", "vacio", "abs", "redondear", "longitud", "contar", "sumar", "valor", "existe"
FUNCTIONS = (IMPLIES, EMPTY, ABSOLUTE, ROUND, LENGTH, COUNT, SUM, VALUE, EXISTS)
_TYPE = {"text": "text", "constant": "text", "integer": "number", "decimal": "number", "date": "date"}


class RuleError(ValueError):
    """A rule that cannot be compiled; the message says why."""


def parse_rule(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise RuleError(f"not an expression: {e.msg}") from None


def _near(name: str, known: list[str]) -> str:
    close = difflib.get_close_matches(name, known, 1, 0.5)
    return f"; did you mean {close[0]}?" if close else ""


@dataclass
class _Need:
    """An aggregate over another record type: joined to the rule's frame on `on` pairs (field of that type, Column here)."""

    name: str
    record: str
    kind: str
    column: str | None
    constants: list[tuple[str, Column]] = field(default_factory=list)
    on: list[tuple[str, Column]] = field(default_factory=list)


class _Compiler:
    def __init__(self, layout: Layout, record: Record | None, prefix: str = "_need"):
        self.layout, self.record, self.needs, self.prefix = layout, record, [], prefix

    def typed(self, node: ast.expr, *kinds: str) -> Column:
        column, kind = self.compile(node)
        if kind not in kinds:
            raise RuleError(f"{ast.unparse(node)} is a {kind}, not a {' or '.join(kinds)}")
        return column

    def compile(self, node: ast.expr) -> tuple[Column, str]:
        match node:
            case ast.Constant(value=bool(v)):
                return F.lit(v), "bool"
            case ast.Constant(value=int() | float() as v):
                return F.lit(Decimal(str(v))), "number"
            case ast.Constant(value=str(v)):
                return F.lit(v), "text"
            case ast.Name(id=name):
                return self._field(name)
            case ast.BoolOp(op=op, values=values):
                out = self.typed(values[-1], "bool")
                for v in reversed(values[:-1]):
                    a = self.typed(v, "bool")
                    early = ~a if isinstance(op, ast.And) else a
                    out = F.when(a.isNull(), F.lit(None).cast("boolean")).when(early, F.lit(isinstance(op, ast.Or))).otherwise(out)
                return out, "bool"
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~self.typed(x, "bool"), "bool"
            case ast.UnaryOp(op=ast.USub() | ast.UAdd() as op, operand=x):
                n = self.typed(x, "number")
                return (-n if isinstance(op, ast.USub) else n), "number"
            case ast.BinOp(left=x, op=op, right=y):
                return self._arithmetic(x, op, y)
            case ast.Compare():
                return self._comparison(node), "bool"
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
                return self._call(name, args)
        raise RuleError(f"{ast.unparse(node)} is not part of the language")

    def _field(self, name: str) -> tuple[Column, str]:
        if self.record is None:
            raise RuleError(f"{name}: a file rule has no fields of its own")
        f = self.record.field(name)
        if f is None:
            raise RuleError(f"record {self.record.code} has no field {name}" + _near(name, [x.name for x in self.record.fields]))
        return F.col(name), _TYPE[f.kind]

    def _arithmetic(self, x: ast.expr, op: ast.operator, y: ast.expr) -> tuple[Column, str]:
        (a, ka), (b, kb) = self.compile(x), self.compile(y)
        if ka == kb == "date" and isinstance(op, ast.Sub):
            return F.date_diff(a, b).cast("decimal(10,0)"), "number"
        if ka != "number" or kb != "number":
            raise RuleError(f"{ast.unparse(x)} and {ast.unparse(y)} are {ka} and {kb}, not numbers")
        match op:
            case ast.Add():
                return a + b, "number"
            case ast.Sub():
                return a - b, "number"
            case ast.Mult():
                return a * b, "number"
            case ast.Div():
                return F.try_divide(a, b), "number"
        raise RuleError("only + - * / join numbers")

    def _comparison(self, node: ast.Compare) -> Column:
        out, left = None, node.left
        for op, right in zip(node.ops, node.comparators):
            if isinstance(op, (ast.In, ast.NotIn)):
                if not isinstance(right, (ast.List, ast.Tuple, ast.Set)) or not all(isinstance(e, ast.Constant) for e in right.elts):
                    raise RuleError("in takes a list of constants")
                a, kind = self.compile(left)
                one = a.isin([self.typed(e, kind) for e in right.elts])
                one = ~one if isinstance(op, ast.NotIn) else one
            else:
                (a, ka), (b, kb) = self.compile(left), self.compile(right)
                if ka != kb:
                    raise RuleError(f"{ast.unparse(left)} is a {ka} and {ast.unparse(right)} a {kb}")
                made = {ast.Eq: a == b, ast.NotEq: a != b, ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b}
                if type(op) not in made:
                    raise RuleError(f"{type(op).__name__} is not part of the language")
                one = made[type(op)]
            out = one if out is None else F.when(out.isNull(), F.lit(None).cast("boolean")).when(~out, F.lit(False)).otherwise(one)
            left = right
        return out

    def _call(self, name: str, args: list[ast.expr]) -> tuple[Column, str]:
        def count(*n: int) -> None:
            if len(args) not in n:
                raise RuleError(f"{name} takes {' or '.join(map(str, n))} arguments")

        if name == IMPLIES:
            count(2)
            a, b = self.typed(args[0], "bool"), self.typed(args[1], "bool")
            return F.when(a.isNull(), F.lit(None).cast("boolean")).when(~a, F.lit(True)).otherwise(b), "bool"
        if name == EMPTY:
            count(1)
            if not isinstance(args[0], ast.Name):
                raise RuleError(f"{EMPTY} takes a field")
            c, _ = self._field(args[0].id)
            return c.isNull() | F.coalesce(strip(c) == "", F.lit(False)), "bool"
        if name == ABSOLUTE:
            count(1)
            return F.abs(self.typed(args[0], "number")), "number"
        if name == ROUND:
            count(1, 2)
            places = args[1].value if len(args) == 2 and isinstance(args[1], ast.Constant) and isinstance(args[1].value, int) else 0 if len(args) == 1 else None
            if places is None:
                raise RuleError(f"{ROUND} takes a constant number of places")
            return F.round(self.typed(args[0], "number"), places), "number"
        if name == LENGTH:
            count(1)
            return F.length(self.typed(args[0], "text")).cast("decimal(10,0)"), "number"
        if name in (COUNT, SUM, VALUE, EXISTS):
            return self._aggregate(name, args)
        raise RuleError(f"no function {name}" + _near(name, list(FUNCTIONS)))

    def _aggregate(self, name: str, args: list[ast.expr]) -> tuple[Column, str]:
        if not args or not isinstance(args[0], ast.Constant):
            raise RuleError(f"{name} takes a record code first")
        record = self.layout.record(str(args[0].value))
        if record is None:
            raise RuleError(f"no record {args[0].value}" + _near(str(args[0].value), [r.code for r in self.layout.records]))
        rest = args[1:]
        column = None
        if name in (SUM, VALUE):
            if not rest:
                raise RuleError(f"{name} takes a field")
            column, rest = self._name_of(rest[0], record), rest[1:]
            if name == SUM and _TYPE[record.field(column).kind] != "number":
                raise RuleError(f"{record.code}.{column} is no number")
        if name == VALUE and (rest or record.most != 1):
            raise RuleError(f"{VALUE} takes the field of a record that occurs once at most")
        if len(rest) % 2 or (name == EXISTS and len(rest) < 2):
            raise RuleError(f"{name} takes pairs of field and value")
        need = _Need(f"{self.prefix}{len(self.needs)}", record.code, name, column)
        for f, v in zip(rest[::2], rest[1::2]):
            other = self._name_of(f, record)
            value = self.typed(v, _TYPE[record.field(other).kind])
            (need.constants if isinstance(v, ast.Constant) else need.on).append((other, value))
        self.needs.append(need)
        c = F.col(need.name)
        if name == VALUE:
            return c, _TYPE[record.field(column).kind]
        if name == EXISTS:
            return F.coalesce(c, F.lit(False)), "bool"
        return F.coalesce(c, F.lit(0)), "number"

    @staticmethod
    def _name_of(node: ast.expr, record: Record) -> str:
        if not isinstance(node, ast.Constant) or record.field(str(node.value)) is None:
            raise RuleError(f"record {record.code} has no field {ast.unparse(node)}" + _near(str(getattr(node, "value", "")), [f.name for f in record.fields]))
        return str(node.value)


def _satisfy(frame: DataFrame, needs: list[_Need], frames: dict[str, DataFrame]) -> DataFrame:
    """frame with a column for each aggregate."""
    for need in needs:
        other = frames[need.record]
        for name, value in need.constants:
            other = other.filter(F.col(name) == value)
        made = {
            COUNT: lambda: F.count(F.lit(1)),
            SUM: lambda: F.sum(need.column),
            EXISTS: lambda: F.count(F.lit(1)) > 0,
            VALUE: lambda: F.when(F.count(F.lit(1)) == 1, F.first(need.column)),
        }[need.kind]()
        keys = [f"{need.name}_k{i}" for i in range(len(need.on))]
        if keys:
            grouped = other.groupBy(*[F.col(f).alias(k) for k, (f, _) in zip(keys, need.on)]).agg(made.alias(need.name))
            at = frame.withColumns({f"{k}_here": v for k, (_, v) in zip(keys, need.on)})
            joined = at.join(grouped, [at[f"{k}_here"] == grouped[k] for k in keys], "left")
            frame = joined.drop(*keys, *[f"{k}_here" for k in keys])
        else:  # one row, whatever the file
            single = F.broadcast(other.agg(made.alias(need.name)).withColumn("_one", F.lit(1)))
            frame = frame.withColumn("_one", F.lit(1)).join(single, "_one", "left").drop("_one")
    return frame


def check_rule(rule: Rule, layout: Layout) -> list[str]:
    """Why a rule cannot be compiled; empty if it can. Needs no data, and no session but for types."""
    record = layout.record(rule.record) if rule.record else None
    if rule.scope == "record" and record is None:
        return [f"no record {rule.record}"]
    try:
        if SparkSession.getActiveSession() is None:
            parse_rule(rule.expression)
        else:
            _Compiler(layout, record if rule.scope == "record" else None).typed(parse_rule(rule.expression), "bool")
    except RuleError as e:
        return [str(e)]
    return []


def evaluate(text: str, layout: Layout, record: str | None, frames: dict[str, DataFrame], spark: SparkSession, name: str = "_result") -> DataFrame:
    """The record type's frame (or one row, for a file) with the expression's value in `name`."""
    compiler = _Compiler(layout, layout.record(record) if record else None)
    value, _ = compiler.compile(parse_rule(text))
    frame = frames[record] if record else spark.range(1).select(F.lit(0).cast("long").alias("_line"))
    return _satisfy(frame, compiler.needs, frames).withColumn(name, value).drop(*[n.name for n in compiler.needs])


def violations(rule: Rule, layout: Layout, frames: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(_line) of the records, or one row for the file, that break the rule."""
    done = evaluate(rule.expression, layout, rule.record if rule.scope == "record" else None, frames, spark)
    return done.filter(F.coalesce(~F.col("_result"), F.lit(False))).select("_line")


def broken_rules(rules: list[Rule], layout: Layout, record: str | None, frames: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(_line, rule) for all rules of one record type, or of the file, in one pass over its frame."""
    frame = frames[record] if record else spark.range(1).select(F.lit(0).cast("long").alias("_line"))
    needs, marks = [], []
    for i, rule in enumerate(rules):
        compiler = _Compiler(layout, layout.record(record) if record else None, f"_need{i}_")
        value = compiler.typed(parse_rule(rule.expression), "bool")
        needs += compiler.needs
        marks.append(F.when(F.coalesce(~value, F.lit(False)), F.lit(rule.id)))
    done = _satisfy(frame, needs, frames)
    return done.select("_line", F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("rule"))
