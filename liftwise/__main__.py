"""Command line: load the data, check its keys, run reports.

    python -m liftwise load --dump dump.sql [--campaigns-csv f --products-csv f --stores-csv f]
                           [--fold-promo-case] --out PATH
    python -m liftwise check --tables PATH
    python -m liftwise report NAME [NAME ...] --tables PATH [--shared-view PATH] [--out PATH | --rows N]
    python -m liftwise sql "SELECT ... FROM sales_summary ..." --tables PATH [--out PATH | --rows N]
    python -m liftwise list

Results are printed in full, or written in full as CSV under ``--out`` (one folder for each
report); ``--rows`` prints only the first rows.

Under spark-submit the platform's session is used; ``--local`` starts a local one.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftwise.operators.star import materialize_summary
from liftwise.plans.reports import REPORTS
from liftwise.plans.views import register_views
from liftwise.schemas import normalise_promo_type
from liftwise.session import local_session
from liftwise.sources.checks import check_keys
from liftwise.sources.csv import read_campaigns_csv, read_products_csv, read_stores_csv
from liftwise.sources.parquet import mark_verified, read_tables, write_tables
from liftwise.sources.sqldump import read_dump_tables
from liftwise.tables import Tables


def _session(local: bool) -> SparkSession:
    return local_session() if local else SparkSession.builder.getOrCreate()


def _load(spark: SparkSession, args) -> None:
    tables = read_dump_tables(spark, args.dump)
    csv_readers = {
        "campaigns": (args.campaigns_csv, read_campaigns_csv),
        "products": (args.products_csv, read_products_csv),
        "stores": (args.stores_csv, read_stores_csv),
    }
    for name, (path, read) in csv_readers.items():
        if path:
            tables[name] = read(spark, path)
    if args.fold_promo_case:
        tables["fact"] = tables["fact"].withColumn("promo_type", normalise_promo_type(F.col("promo_type")))
    write_tables(Tables(**tables), args.out)
    print(f"wrote {args.out}")


def _put(df: DataFrame, name: str, args) -> None:
    """All rows of ``df``: to files, or as tab-separated lines, one row at a time."""
    if args.out:
        df.write.option("header", True).csv(f"{args.out}/{name}")
        print(f"wrote {args.out}/{name}")
        return
    print("\t".join(df.columns))
    shown = df.limit(args.rows) if args.rows is not None else df
    for row in shown.toLocalIterator():
        print("\t".join("NULL" if v is None else str(v) for v in row))


def _check(spark: SparkSession, args) -> None:
    _put(check_keys(read_tables(spark, args.tables)), "check", args)
    mark_verified(spark, args.tables)


def _report(spark: SparkSession, args) -> None:
    t = read_tables(spark, args.tables)
    if args.shared_view:
        t = materialize_summary(t, args.shared_view)
    for name in args.names:
        print(f"== {name}")
        _put(REPORTS[name](t), name, args)


def _sql(spark: SparkSession, args) -> None:
    register_views(spark, read_tables(spark, args.tables))
    for i, statement in enumerate(args.statements, 1):
        _put(spark.sql(statement), f"sql{i}", args)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="liftwise", description=__doc__.splitlines()[0])
    parser.add_argument("--local", action="store_true", help="start a local Spark session")
    sub = parser.add_subparsers(dest="command", required=True)

    load = sub.add_parser("load", help="ingest a dump (and CSV dimensions) and write the tables")
    load.add_argument("--dump", required=True)
    load.add_argument("--campaigns-csv")
    load.add_argument("--products-csv")
    load.add_argument("--stores-csv")
    load.add_argument("--out", required=True)
    load.add_argument(
        "--fold-promo-case", action="store_true", help="trim and upper-case promotion names once, at the load (T16)"
    )

    check = sub.add_parser("check", help="check declared keys and NOT NULL columns")
    check.add_argument("--tables", required=True)
    check.add_argument("--out")
    check.set_defaults(rows=None)

    report = sub.add_parser("report", help="run reports by name")
    report.add_argument("names", nargs="+", choices=sorted(REPORTS))
    report.add_argument("--tables", required=True)
    report.add_argument("--shared-view", metavar="PATH", help="write the view's sums once to PATH, on shared storage, and share them")
    report.add_argument("--out", help="write each result in full to a folder under this one")
    report.add_argument("--rows", type=int, help="print only so many rows")

    sql = sub.add_parser("sql", help="run SQL over fact_events, dim_* and sales_summary")
    sql.add_argument("statements", nargs="+")
    sql.add_argument("--tables", required=True)
    sql.add_argument("--out", help="write each result in full to a folder under this one")
    sql.add_argument("--rows", type=int, help="print only so many rows")

    sub.add_parser("list", help="list the report names")

    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(REPORTS))
        return 0
    spark = _session(args.local)
    {"load": _load, "check": _check, "report": _report, "sql": _sql}[args.command](spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
