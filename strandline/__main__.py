"""python -m strandline list | run NAME | explain NAME: the registered queries from the command line.

``--also MODULE`` adds the queries of a module that has a ``queries()`` of its own.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from strandline import catalog
from strandline.functions.names import split_option
from strandline.sources.sinks import tagged


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandline")
    parser.add_argument("--also", default="", help="modules, split by commas, whose queries are added")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    for name, what in (("run", "write or show queries' rows"), ("explain", "show a query's plan")):
        sub = commands.add_parser(name, help=what)
        sub.add_argument("query", help="a name; run takes several, split by commas")
        sub.add_argument("--data", required=True, help="folder of the tables")
        if name == "run":
            sub.add_argument("--out", help="folder to write to, a Parquet table a query; without it the first rows are shown")
            sub.add_argument("--output-tag", help="put behind the tables' names")
            sub.add_argument("--resume", action="store_true", help="leave out queries whose table is complete")
            sub.add_argument("--rows", type=int, default=20, help="rows to show")
    args = parser.parse_args(argv)
    known = catalog.queries()
    for module in split_option(args.also):
        known |= importlib.import_module(module).queries()
    if args.command == "list":
        print("\n".join(sorted(known)))
        return
    wanted = split_option(args.query)
    if unknown := [n for n in wanted if n not in known]:
        parser.error(f"no query named {', '.join(unknown)}")
    spark = SparkSession.builder.appName(f"strandline {args.query}").getOrCreate()
    for name in wanted:
        if args.command == "explain":
            known[name](spark, args.data).explain("formatted")
        elif args.out:
            path = tagged(f"{args.out.rstrip('/')}/{name}", args.output_tag)
            if args.resume and _complete(spark, path):
                print(f"{name}: complete")
                continue
            known[name](spark, args.data).write.mode("overwrite").parquet(path)
        else:
            known[name](spark, args.data).show(args.rows, truncate=False)


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a writer has finished the table."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


if __name__ == "__main__":
    main()
