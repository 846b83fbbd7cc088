"""Commands: ``python -m latticeworks query NAME DIR``, ``list``, ``eval FORMULA TABLE.parquet``, ``check BUILD``, ``vectors``."""

from __future__ import annotations

import argparse
import json
import sys

from .session import build


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="latticeworks", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of queries, with the operators they cover")
    run = commands.add_parser("query", help="rows of a query, a line of JSON each")
    run.add_argument("name")
    run.add_argument("dir")
    run.add_argument("--limit", type=int, default=20)
    one = commands.add_parser("eval", help="a formula over the columns of a table")
    one.add_argument("formula")
    one.add_argument("table")
    one.add_argument("--limit", type=int, default=20)
    whole = commands.add_parser("check", help="what is wrong with a build; exit 1 if anything is")
    whole.add_argument("path")
    commands.add_parser("vectors", help="streams, draws and noise at fixed places")
    args = parser.parse_args(argv)

    if args.command == "vectors":
        from .functions import draws

        s = draws.stream(0, ["noise", "seed", "hills"])
        print(json.dumps({"splitmix64(0)": hex(int(draws.splitmix64(0))), "stream": hex(s), "draw": hex(int(draws.draw_words(s, [0], [0], [0])[0]))}))
        return 0
    from .plans import catalogue

    if args.command == "list":
        for name, f in sorted(catalogue.QUERIES.items()):
            print(f"{name}: {f.__doc__}")
        return 0
    if args.command == "query" and args.name not in catalogue.QUERIES:
        from .sources.world import nearest

        hint = nearest(args.name, list(catalogue.QUERIES))
        print(f"unknown query {args.name}" + (f", did you mean {hint}?" if hint else ""), file=sys.stderr)
        return 2
    if args.command == "eval":
        from .functions.formula import FormulaError, parse

        try:
            parse(args.formula)
        except FormulaError as e:
            print(e, file=sys.stderr)
            return 1
    spark = build()
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "check":
        from .sinks.build import check

        found = check(spark, args.path)
        print("\n".join(found) or "ok")
        return int(bool(found))
    if args.command == "query":
        rows = catalogue.QUERIES[args.name](spark, args.dir)
    else:
        from pyspark.sql import functions as F

        from .functions.formula import Scope, compile_formula

        table = spark.read.parquet(args.table)
        numbers = [f.name for f in table.schema if f.dataType.typeName() in ("long", "integer", "double", "float", "short")]
        rows = table.withColumn("value", compile_formula(args.formula, Scope({n: F.col(n).cast("double") for n in numbers})))
    for line in rows.limit(args.limit).toJSON().collect():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
