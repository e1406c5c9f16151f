"""Command line: list, run and explain registered queries, and answer questions over a folder of tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import load_env_file
from .plans.q_answers import answered
from .plans.queries import QUERIES


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quern", description=__doc__)
    top.add_argument("--env", default=".env", help="a file of settings")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of queries")
    for name, text in (("run", "show a query's rows"), ("explain", "show a query's plan")):
        each = sub.add_parser(name, help=text)
        each.add_argument("query", choices=sorted(QUERIES))
        each.add_argument("--data", required=True)
        each.add_argument("--rows", type=int, default=20)
    ask = sub.add_parser("answer", help="answer questions from the documents")
    ask.add_argument("--data", required=True)
    ask.add_argument("--pinned", default=None, help="a language such as en-IN")
    ask.add_argument("question", nargs="+")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    load_env_file(args.env)
    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return
    spark = SparkSession.builder.appName("quern").getOrCreate()
    if args.command == "answer":
        asked = spark.createDataFrame([(i, q, args.pinned) for i, q in enumerate(args.question)], "qid long, text string, pinned_language string")
        answered(spark, args.data, asked).select("text", "answer_mode", "reason", "answer").show(truncate=False, vertical=True)
    elif args.command == "run":
        QUERIES[args.query](spark, args.data).show(args.rows, truncate=80)
    else:
        QUERIES[args.query](spark, args.data).explain("formatted")


if __name__ == "__main__":
    main()
