"""Command line: build the models, run the data tests, show the reports.

  python -m tidemark build  --driver SF_DIR | --raw name=path ... --out DIR --as-of DATE
  python -m tidemark test   (same inputs)   runs the 55 data tests on the built tables
  python -m tidemark report (same inputs) [--name REPORT] [--regions R ...] [--sources S ...]
                            prints dashboard reports

``--driver`` reads the test tables through the fixture binding; ``--raw`` takes
Parquet paths of the six raw tables (users, user_events, subscriptions,
feature_usage, invoices, conversations), cast to their contracts.  ``build``
writes every model under ``--out`` (the event fact loads incrementally when it
exists); ``test`` and ``report`` build first, then read the built tables.
"""

from __future__ import annotations

import argparse
import sys


def _tables(spark, args):
    if args.driver:
        from tidemark.sources.bindings import driver_tables
        return driver_tables(spark, args.driver)
    from tidemark.sources.tables import Tables
    paths = dict(item.split("=", 1) for item in args.raw)
    return Tables.from_paths(spark, paths)


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="python -m tidemark")
    ap.add_argument("command", choices=["build", "test", "report"])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--driver", help="folder of the driver's test tables")
    src.add_argument("--raw", nargs="+", metavar="NAME=PATH", help="raw table paths")
    ap.add_argument("--out", required=True, help="folder for the built tables")
    ap.add_argument("--as-of", required=True, help="reporting date, YYYY-MM-DD")
    ap.add_argument("--first-month", default=None)
    ap.add_argument("--last-month", default=None)
    ap.add_argument("--name", default=None, help="one report (default: all)")
    ap.add_argument("--regions", nargs="*", default=None,
                    help="regions of the reports (none named: all known regions)")
    ap.add_argument("--sources", nargs="*", default=None,
                    help="signup sources of the reports (none named: the fallback source)")
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    from tidemark.plans.build import BuildParams, build_models, dashboard
    from tidemark.plans.reports import Filters
    from tidemark.session import build_session

    spark = build_session(args.master)
    params = BuildParams(as_of=args.as_of)
    if args.first_month and args.last_month:
        params = BuildParams(as_of=args.as_of, first_month=args.first_month,
                             last_month=args.last_month)
    tables = _tables(spark, args)
    models = build_models(spark, tables, args.out, params)
    if args.command == "build":
        for name, df in models.items():
            print(f"{name}: {df.count()} rows")
    elif args.command == "test":
        from tidemark.plans.suite import built_frames, spark_suite
        rows = spark_suite(built_frames(tables, models)).collect()   # one row per test
        for r in rows:
            print(f"{'PASS' if r.passed else 'FAIL'} {r.test_name} ({r.violations})")
        if not all(r.passed for r in rows):
            return 1
    else:
        chosen = Filters(*(None if x is None else tuple(x)
                           for x in (args.regions, args.sources)))
        reports = dashboard(models, args.as_of, chosen)
        for name, df in reports.items():
            if args.name in (None, name):
                print(f"== {name}")
                print("\t".join(df.columns))
                for r in df.toLocalIterator():          # every row, one partition at a time
                    print("\t".join("" if v is None else str(v) for v in r))
    return 0


if __name__ == "__main__":
    sys.exit(main())
