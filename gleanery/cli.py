"""Command line: index a collection, evaluate search quality, or run one query.

    spark-submit gleanery/cli.py --dataset scifact --data-dir data/scifact --parent-index-dir /indices index
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleanery.engine import ENGINES, directory_size, engine, engine_dir, evaluate
from gleanery.functions.ids import format_si
from gleanery.sources.tables import dataset, nth_query


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gleanery", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--engines", default="bm25", help=f"comma-separated: {', '.join(ENGINES)}")
    parser.add_argument("--dataset", required=True, help="cisi, enwiki, simplewiki, enwiki_json, nfcorpus, scifact, beir_*")
    parser.add_argument("--data-dir", required=True, help="where the collection's files lie")
    parser.add_argument("--parent-index-dir", default=".", help="every engine has a folder index_<engine> in it")
    commands = parser.add_subparsers(dest="command", required=True)
    indexing = commands.add_parser("index", help="index the documents")
    indexing.add_argument("--max-segment-docs", type=int, default=25_000)
    commands.add_parser("eval", help="measure search quality")
    one = commands.add_parser("search", help="run one query of the collection")
    one.add_argument("--query-number", type=int, default=10, help="its place, from 0")
    return parser


def progress_line(docs: int, size: int, seconds: float, total: int | None = None) -> str:
    """Documents and bytes so far, both a second, and the minutes left where the total is known."""
    per_second = docs / max(1e-9, seconds)
    line = f"{format_si(docs, 'docs')} ({format_si(per_second, 'docs/sec')}) {format_si(size, 'B')} ({format_si(size / max(1e-9, seconds), 'B/sec')})"
    return line if total is None else f"{line} ETA ~{int((total - docs) / max(1e-9, per_second) / 60)} minutes"


def quality_lines(row, limit: int) -> list[str]:
    lines = [f"queries count: {row.queries}"]
    for name in ("precision", "recall"):
        shares = " ".join(f"p{p}={row[f'{name}_p{p}']:<6.2f}" for p in (50, 90, 100))
        lines.append(f"{name.capitalize():<10}@{limit:<2}:  avg={row[f'{name}_avg']:<6.3f} {shares}")
    return [*lines, f"{'nDCG':<10}@{limit:<2}:  avg={row.ndcg_avg:<6.3f}"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs a command and returns the lines that it prints."""
    args = arguments().parse_args(argv)
    kinds = [engine(name) for name in args.engines.split(",")]
    spark = spark or SparkSession.builder.appName("gleanery").getOrCreate()
    data = dataset(spark, args.dataset, args.data_dir)
    lines: list[str] = []
    for kind in kinds:
        path = engine_dir(args.parent_index_dir, kind.name)
        lines.append(f"engine: {kind.name}")
        if args.command == "index":
            began = time.time()
            made = kind.create_on_disk(spark, path, **({"max_segment_docs": args.max_segment_docs} if hasattr(kind, "analyser") else {}))
            made.index_docs(data.docs)
            seconds = time.time() - began
            count, size = data.docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
            lines.append(f"indexed {progress_line(count, size, seconds)}")
            lines.append(f"index size: {format_si(directory_size(spark, path), 'B')}")
            continue
        opened = kind.open_from_disk(spark, path)
        if args.command == "eval":
            lines += quality_lines(evaluate(opened, data.queries, data.qrels).first(), 10)
        else:
            chosen = nth_query(data.queries, args.query_number).first()
            lines += [f"query: {chosen.text}", f"found: {opened.search(chosen.text)}"]
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
