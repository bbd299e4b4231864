"""Command line for the four jobs.

    python -m sightline build-metrics EXPORT_DIR OUT_ROOT [--as-of D] [--start D --end D] [--grains week,day]
                                      [--csv] [--single-line]
    python -m sightline build-charts  OUT_ROOT CHART_ROOT [--min-year Y] [--csv]
    python -m sightline check-counts  EXPORT_DIR [--metrics OUT_ROOT] [--csv] [--single-line]
    python -m sightline ingest        PAGES_DIR TABLE [--path P] [--backfill] [--rejects P] [--most-unreadable S]
                                      [--multi-line]

On a cluster submit it with spark-submit; the session settings come from
the cluster (only sightline's defaults that are unset are added).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from sightline.session import build_session


def _single_line(p: argparse.ArgumentParser) -> None:
    p.add_argument(
        "--single-line",
        action="store_true",
        help="exports have no quoted line breaks: do not look for them (files that have any are read by one task each)",
    )


def _fmt(args: argparse.Namespace) -> str:
    return "csv" if args.csv else "parquet"


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sightline")
    sub = parser.add_subparsers(dest="cmd", required=True)

    p = sub.add_parser("build-metrics", help="exports -> fact and weekly metric tables")
    p.add_argument("export_dir")
    p.add_argument("out_root")
    p.add_argument("--as-of", default=None)
    p.add_argument("--start", default=None, help="first day of the calendar (else derived from the data)")
    p.add_argument("--end", default=None, help="last day of the calendar (else derived from the data)")
    p.add_argument("--grains", default="week", help="comma-separated: day, week, month, quarter, year")
    p.add_argument("--csv", action="store_true", help="write metric tables as CSV with header")
    _single_line(p)

    p = sub.add_parser("build-charts", help="metric tables -> long-form chart series")
    p.add_argument("metrics_root")
    p.add_argument("chart_root")
    p.add_argument("--min-year", type=int, default=2018)
    p.add_argument("--csv", action="store_true", help="the metric tables were written as CSV")

    p = sub.add_parser("check-counts", help="rows vs distinct ids, and metric previews")
    p.add_argument("export_dir")
    p.add_argument("--metrics", default=None)
    p.add_argument("--csv", action="store_true", help="the metric tables were written as CSV")
    _single_line(p)

    p = sub.add_parser("ingest", help="landed API pages -> insert-only merge into a table")
    p.add_argument("pages_dir")
    p.add_argument("table")
    p.add_argument("--path", default=None, help="location of the table files when it is created")
    p.add_argument("--backfill", action="store_true")
    p.add_argument("--rejects", default=None, help="folder for unreadable pages, records without an id and unreadable dates")
    p.add_argument("--outside", choices=["append", "reject"], default="append", help="what becomes of late and undated records")
    p.add_argument("--metric-store", default=None, help="folder of a metric store to keep up to date with the table")
    p.add_argument("--most-unreadable", type=float, default=0.0, help="share of unreadable pages to accept")
    p.add_argument("--multi-line", action="store_true", help="each file is one (indented) page")

    args = parser.parse_args(argv)
    owned = SparkSession.getActiveSession() is None
    spark = build_session(app_name=f"sightline-{args.cmd}")

    if args.cmd == "build-metrics":
        from sightline.plans.metric_build import build_metrics
        from sightline.sources.observations_csv import read_observations_csv

        raw = read_observations_csv(spark, args.export_dir, multi_line=False if args.single_line else None)
        paths = build_metrics(
            spark, raw, args.out_root, as_of=args.as_of, start=args.start, end=args.end,
            grains=args.grains.split(","), fmt=_fmt(args),
        )
        print(json.dumps(paths, indent=2))
    elif args.cmd == "build-charts":
        from sightline.plans.chart_series import build_series

        paths = build_series(spark, args.metrics_root, args.chart_root, min_year=args.min_year, fmt=_fmt(args))
        print(json.dumps(paths, indent=2))
    elif args.cmd == "check-counts":
        from sightline.plans.count_check import count_check
        from sightline.sources.observations_csv import read_observations_csv

        obs = read_observations_csv(spark, args.export_dir, multi_line=False if args.single_line else None)
        audit_rows, previews = count_check(spark, obs, args.metrics, fmt=_fmt(args))
        for row in audit_rows:
            print(row.asDict())
        for name, rows in previews.items():
            print(name, [r.asDict() for r in rows])
    elif args.cmd == "ingest":
        from sightline.plans.incremental import ingest_pages
        from sightline.plans.metric_store import MetricStore
        from sightline.streaming.ingest_stream import MergeCounts
        from sightline.tracked_species import ALL_TRACKED

        counts = MergeCounts()
        store = MetricStore(spark, args.metric_store, tracked=ALL_TRACKED) if args.metric_store else None
        appended = ingest_pages(
            spark, args.pages_dir, args.table, table_path=args.path, backfill=args.backfill,
            rejects_path=args.rejects, most_unreadable=args.most_unreadable, multi_line=args.multi_line,
            outside=args.outside, counts=counts, metrics=store,
        )
        print(f"appended {appended} new records to {args.table}")
        print(f"pages read {counts.pages}, unreadable {counts.unreadable}, with gaps in their ids {counts.with_gaps}")
        print(f"records without id {counts.without_id}, late {counts.late}, undated {counts.undated}")
    if owned:
        spark.stop()


if __name__ == "__main__":
    main()
