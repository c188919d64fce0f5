"""Command lines: build an index from JSONL, answer a file of queries.

    python -m tessera.cli index -c corpus.jsonl -i index/ [--max-docs N] [--threads N] [-m MB]
    python -m tessera.cli search -i index/ -q queries.txt -r BM25
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from .operators import search as se
from .operators.galloping import galloping_metrics, run_averages
from .session import MemoryMonitor, progress, ship
from .sources import index_store
from .sources.corpus import contents, read_jsonl
from .sources.query_file import read_queries


def _number(least: int):
    def parse(value: str) -> int:
        if int(value) < least:
            raise argparse.ArgumentTypeError(f"must be at least {least}")
        return int(value)

    return parse


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="index a JSONL corpus")
    index.add_argument("-c", "--corpus", required=True)
    index.add_argument("-i", "--index", required=True)
    index.add_argument("-m", "--memory", type=_number(1), help="driver memory in MB for a local run")
    index.add_argument("--max-docs", type=int)
    index.add_argument("--threads", type=_number(1), help="local threads; without it the session's master is used")
    index.add_argument("--progress", type=_number(1), help="report running stages every so many seconds")
    search = commands.add_parser("search", help="answer one query a line")
    search.add_argument("-i", "--index", required=True)
    search.add_argument("-q", "--queries", required=True)
    search.add_argument("-r", "--ranker", required=True, type=lambda r: r.strip().upper(), choices=["TFIDF", "BM25"])
    search.add_argument("-k", type=_number(1), default=se.TOP_K)
    search.add_argument("--threads", type=_number(1))
    search.add_argument("--stats", action="store_true", help="also report what skipping through the lists would save, and the time a query takes")
    return top


def session(args: argparse.Namespace) -> SparkSession:
    builder = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false")
    if args.threads:
        builder = builder.master(f"local[{args.threads}]").config("spark.sql.shuffle.partitions", str(2 * args.threads))
    if getattr(args, "memory", None):
        builder = builder.config("spark.driver.memory", f"{args.memory}m")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = index_store._hadoop(spark, path)
    return fs.exists(where)


def run_index(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Build the index and describe it: size in MB, seconds, number and average size of lists."""
    began, monitor = time.time(), MemoryMonitor(getattr(args, "memory", None) or 1024, spark)
    corpus = read_jsonl(spark, args.corpus, args.max_docs)
    rejected = 0
    for row in corpus.rejects.orderBy("path", "line_no").toLocalIterator():
        print(f"{row.path}:{row.line_no}: {row.reason}", file=sys.stderr)
        rejected += 1
    print(f"{rejected} lines rejected", file=sys.stderr)
    if getattr(args, "progress", None):
        with progress(spark, args.progress):
            index_store.save(contents(corpus.documents), args.index)
    else:
        index_store.save(contents(corpus.documents), args.index)
    print(f"memory: {monitor.used_mb():.0f} MB in use of a budget of {monitor.budget_mb:.0f}", file=sys.stderr)
    found = index_store.statistics(spark, args.index).first()
    return {"Index Size": found.index_size_mb, "Elapsed Time": round(time.time() - began, 2), "Number of Lists": found.number_of_lists, "Average List Size": found.average_list_size}


def run_search(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """One JSON line for each query, in order; a batch of k results a query fits the driver that prints it."""
    queries, index, began = read_queries(spark, args.queries), index_store.load(spark, args.index), time.time()
    found = se.search(index, queries, args.ranker, args.k)
    lines = [row.value for row in se.as_json(se.results(queries, found)).collect()]
    if getattr(args, "stats", False):
        spent = time.time() - began
        report = run_averages(galloping_metrics(index, queries)).first().asDict()
        print(json.dumps(report | {"ms_a_query": round(1000 * spent / max(1, len(lines)), 2)}), file=sys.stderr)
    return lines


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session(args)
    for path in [args.corpus] if args.command == "index" else [args.index, args.queries]:
        if not _exists(spark, path):
            print(f"{path} does not exist", file=sys.stderr)
            return 1
    if args.command == "index":
        print(json.dumps(run_index(spark, args)))
    else:
        print("\n".join(run_search(spark, args)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
