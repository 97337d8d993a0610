"""python -m cotejo: check LAYOUT | validate LAYOUT FILE | schema LAYOUT | synthesise LAYOUT FOLDER | pair A.csv B.csv [--key a=b] [--compare a=b] [--out FOLDER]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from cotejo.operators.keys import suggest_comparisons, suggest_pair_key
from cotejo.operators.pairs import reconcile_pair
from cotejo.sources.tables import read_csv, write_tables
from cotejo.spec.layout import layout_problems, load_layout
from cotejo.spec.readers import read_records
from cotejo.spec.synthesis import synthesise
from cotejo.spec.validate import validate
from cotejo.spec.writers import render_lines, write_lines, xml_schema


#: Findings that are printed.
SHOWN = 1000


def _pairs(given: list[str]) -> list[tuple[str, str]]:
    return [tuple(x.split("=", 1)) if "=" in x else (x, x) for x in given]


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="cotejo", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("check", "validate", "schema", "synthesise"):
        sub = commands.add_parser(name)
        sub.add_argument("layout")
        if name in ("validate", "synthesise"):
            sub.add_argument("path")
        if name == "synthesise":
            sub.add_argument("--rows", type=int, default=4)
            sub.add_argument("--seed", type=int, default=0)
    pair = commands.add_parser("pair")
    pair.add_argument("a")
    pair.add_argument("b")
    pair.add_argument("--key", action="append", default=[])
    pair.add_argument("--compare", action="append", default=[])
    pair.add_argument("--tolerance", default="0.01")
    pair.add_argument("--out")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("cotejo").getOrCreate()
    if given.command == "pair":
        a, b = read_csv(spark, given.a), read_csv(spark, given.b)
        keys = _pairs(given.key) or [(p.left, p.right) for p in suggest_pair_key(a, b)[:1]]
        if not keys:
            print("no key found; give one with --key", file=sys.stderr)
            return 2
        left, right = [k[0] for k in keys], [k[1] for k in keys]
        compare = _pairs(given.compare) or suggest_comparisons(a.columns, b.columns, left, right)
        done = reconcile_pair(a, b, left, right, compare, given.tolerance)
        for k, v in done.summary(a, b, left, right).items():
            print(f"{k}: {v}")
        if given.out:
            frames = {"only_a": done.only_a, "only_b": done.only_b, "differences": done.differences, "equal": done.equal, "duplicates_a": done.duplicates_a, "duplicates_b": done.duplicates_b}
            write_tables({n: f.drop("_pos") for n, f in frames.items()}, given.out)
        return 0
    layout = load_layout(given.layout)
    if given.command == "schema":
        print(xml_schema(layout))
        return 0
    if given.command == "synthesise":
        write_lines(render_lines(synthesise(spark, layout, given.rows, given.seed), layout), given.path, layout)
        return 0
    problems = layout_problems(layout)
    if given.command == "check":
        print("\n".join(problems) or "no problems")
        return int(bool(problems))
    found = validate(read_records(spark, given.path, layout), layout, spark).orderBy("line", "origin").limit(SHOWN + 1).collect()
    for f in found[:SHOWN]:
        print(" ".join(str(x) for x in (f.severity, f.origin, f.line, f.record_type, f.field, f.rule, f.message) if x is not None))
    if len(found) > SHOWN:
        print(f"more than {SHOWN} findings; the first are shown")
    return int(bool(found))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
