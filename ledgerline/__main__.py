"""Run one job: `spark-submit ... -m ledgerline <job> ...` or `python -m ledgerline <job> ...`."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from ledgerline import schemas
from ledgerline.plans import jobs
from ledgerline.session import build_session
from ledgerline.sources import readers

# Jobs over one run date's file: they share the arguments and the call.
DATED = {
    "daily": jobs.run_daily_job,
    "channel": jobs.run_channel_job,
    "simple": jobs.run_simple_job,
    "keys": jobs.run_key_summary_job,
}


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="ledgerline")
    job = parser.add_subparsers(dest="job", required=True)

    def add(name: str, *names: str, help: str) -> argparse.ArgumentParser:
        sub = job.add_parser(name, help=help)
        for argument in names:
            sub.add_argument(argument)
        return sub

    add("sales", "input", "output", help="JSON sales to four Parquet summaries")
    add("clean", "input", "output", "stats", help="CSV to cleaned CSV and its statistics")
    for name in DATED:
        add(name, "input", "output", "date", help=f"the {name} reports of one run date")
    add("quality", "input", "output", "date", help="CSV payments to a validation report")
    add("ingest", "output", "date", help="generate payments and report on them")
    add("analysis", "input", "output", "date", help="demo sales to three reports").add_argument(
        "--region", default="all"
    )
    add("metrics", "input", "output", "date", help="CSV metrics to profile reports")
    return parser


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "sales":
        result = jobs.run_sales_job(spark, args.input, args.output)
    elif args.job == "clean":
        result = jobs.run_clean_job(spark, args.input, args.output, args.stats)
    elif args.job in DATED:
        result = DATED[args.job](spark, args.input, args.output, args.date)
    elif args.job == "quality":
        payments = readers.read_csv(spark, args.input, schemas.PAYMENTS)
        result = jobs.run_quality_job(payments, args.output, args.date)
    elif args.job == "ingest":
        result = jobs.run_ingest_job(spark, args.output, args.date)
    elif args.job == "analysis":
        result = jobs.run_analysis_job(spark, args.input, args.output, args.date, args.region)
    else:
        metrics = readers.read_csv(spark, args.input, schemas.METRICS)
        result = jobs.run_metrics_job(metrics, args.output, args.date)
    result.show(truncate=False)


def main(argv: Sequence[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    run(build_session(f"ledgerline-{args.job}"), args)


if __name__ == "__main__":
    main()
