"""Command line: ``list`` the registered queries, ``show`` or ``write`` the result of one, ``explain`` its plan."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quakeweave.plans import analytics, quality


def known() -> dict:
    """The registered queries; those of other packages are in ``__spark_entry__``."""
    return {**analytics.QUERIES, **quality.QUERIES}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quakeweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("show", "write", "explain"):
        s = sub.add_parser(name)
        s.add_argument("query")
        s.add_argument("folder", help="folder of the Parquet tables")
        if name == "write":
            s.add_argument("output")
        if name == "show":
            s.add_argument("--rows", type=int, default=20)
    a = p.parse_args(argv)
    if a.command == "list":
        print("\n".join(known()))
        return 0
    # spark-submit or the caller sets master and resources.
    spark = SparkSession.builder.appName("quakeweave").getOrCreate()
    df = known()[a.query](spark, a.folder)
    if a.command == "show":
        df.show(a.rows, truncate=False)
    elif a.command == "explain":
        df.explain("formatted")
    else:
        df.write.mode("overwrite").parquet(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
