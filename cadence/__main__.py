"""Command line: build the store, or print a growth report.

  python -m cadence migrate <reports_dir> <store_dir>
  python -m cadence report <reports_dir|store_dir> --type "Vehicle Category" --metric yoy \\
      [--name 2W] [--from 2018] [--to 2024] [--store]

Results are printed row by row as they come from the executors (one partition
at a time on the driver); ``--out DIR`` writes the table and the insights as CSV folders instead.
"""

from __future__ import annotations

import argparse
import sys

from cadence import app
from cadence.session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cadence")
    sub = p.add_subparsers(dest="cmd", required=True)
    mg = sub.add_parser("migrate", help="load report files into the Parquet store")
    mg.add_argument("reports")
    mg.add_argument("store")
    rp = sub.add_parser("report", help="growth table and insight for one kind")
    rp.add_argument("source")
    rp.add_argument("--type", required=True, dest="data_type")
    rp.add_argument("--metric", choices=["yoy", "qoq"], default="yoy")
    rp.add_argument("--name")
    rp.add_argument("--from", type=int, dest="lo")
    rp.add_argument("--to", type=int, dest="hi")
    rp.add_argument("--store", action="store_true", help="source is a store folder (store profile)")
    rp.add_argument("--out", help="write table and insights to this folder instead of printing them")
    args = p.parse_args(argv)

    spark = local_session("*")
    if args.cmd == "migrate":
        built = app.build_store(spark, args.reports, args.store)
        for r in built.rejects.toLocalIterator():
            print(f"skipped {r['Report']}: {r['Reason']}")
        for r in built.warnings.toLocalIterator():
            print(f"{r['Report']}: {r['Reason']} in {r['Cells']} cells")
        print(f"store written to {args.store}")
        return 0
    facts = app.load_store(spark, args.source) if args.store else app.load_facts(spark, args.source)
    rng = (args.lo, args.hi) if args.lo is not None or args.hi is not None else None
    rep = app.growth_report(facts, args.data_type, args.metric, args.name, rng)
    if args.out:
        rep.table.write.mode("overwrite").option("header", "true").csv(f"{args.out}/table")
        rep.insight.orderBy("Name").write.mode("overwrite").option("header", "true").csv(f"{args.out}/insights")
        return 0
    for r in rep.table.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in r))
    for r in rep.insight.orderBy("Name").toLocalIterator():
        print(r["Insight"], end="\n\n")
    for r in rep.notice.toLocalIterator():
        print(r["Reason"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
