"""Command line: python -m strandline.cli COMMAND ...; each command is a thin call into the library."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from strandline.operators import publish
from strandline.plans import core, registry
from strandline.sources import archives, rawlog


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline", description="Market-evidence queries on Spark")
    p.add_argument("--master", default=None, help="Spark master; by default the environment's")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    for name, text in (("run", "run a query over a folder of tables"), ("explain", "show a query's plan"), ("sql", "show a query's DuckDB oracle")):
        c = sub.add_parser(name, help=text)
        c.add_argument("query", choices=sorted(core.QUERIES), metavar="QUERY")
        if name != "sql":
            c.add_argument("tables")
        if name == "run":
            c.add_argument("--out", help="write Parquet here instead of showing rows")
            c.add_argument("--rows", type=int, default=20)
    c = sub.add_parser("publish", help="write a query's result once, named by its content")
    c.add_argument("query", choices=sorted(core.QUERIES), metavar="QUERY")
    c.add_argument("tables")
    c.add_argument("root")
    c.add_argument("--order", nargs="+", required=True)
    c = sub.add_parser("audit-log", help="tail states of raw-log segments")
    c.add_argument("folder")
    c = sub.add_parser("recover-log", help="cut the incomplete tail off a segment")
    c.add_argument("file")
    c = sub.add_parser("store-archive", help="CSV archive to partitioned Parquet")
    c.add_argument("kind", choices=sorted(archives.COLUMNS))
    c.add_argument("path")
    c.add_argument("root")
    c = sub.add_parser("archive-stats", help="counts, span and reversals of a CSV archive of one day")
    c.add_argument("kind", choices=sorted(archives.COLUMNS))
    c.add_argument("path")
    c.add_argument("day")
    return p


def session(master: str | None) -> SparkSession:
    b = SparkSession.builder.appName("strandline").config("spark.sql.session.timeZone", "UTC")
    return (b.master(master) if master else b).getOrCreate()


def show(df: DataFrame, rows: int = 20) -> None:
    for r in df.limit(rows).toJSON().collect():
        print(r)


def main(args: Sequence[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "list":
        print("\n".join(sorted(core.QUERIES)))
        return 0
    if a.command == "sql":
        print(registry.oracle_sql().get(a.query, "-- SQL cannot express this query"))
        return 0
    if a.command == "recover-log":
        print(rawlog.recover(a.file))
        return 0
    spark = session(a.master)
    if a.command in ("run", "explain", "publish"):
        df = core.QUERIES[a.query](spark, a.tables)
        if a.command == "explain":
            df.explain("formatted")
        elif a.command == "publish":
            print(json.dumps(publish.publish({a.query: df}, {a.query: a.order}, a.root), sort_keys=True))
        elif a.out:
            df.write.parquet(a.out)
        else:
            show(df, a.rows)
    elif a.command == "audit-log":
        show(rawlog.audit(rawlog.raw_frames(spark, a.folder, audit=True)).orderBy("segment"), 1_000_000)
    elif a.command == "store-archive":
        archives.store_archive(archives.read_archive(spark, a.path, a.kind), a.root, a.kind)
    elif a.command == "archive-stats":
        show(archives.archive_stats(archives.read_archive(spark, a.path, a.kind), a.day))
    return 0


if __name__ == "__main__":
    sys.exit(main())
