"""The whole run as a Spark job:

    spark-submit --py-files lotscope.zip lotscope/plans/job.py --tables DIR --out DIR

Exit code 0: all sections of all reports written; 1: the marts could not be refreshed;
2: some section of some report failed; ``section_status`` says which.
"""

from __future__ import annotations

import argparse
import logging
import time
from dataclasses import fields

from pyspark.sql import SparkSession

from lotscope.model import Params
from lotscope.operators.reports import report_list, select_reports
from lotscope.plans.refresh import refresh_marts, with_stored_marts
from lotscope.plans.run import run_reports
from lotscope.sources.tables import read_parquet
from lotscope.workspace import Workspace

log = logging.getLogger(__name__)

# Settings the analyses rely on; anything about size is left to the cluster.
SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Profile imported observations.")
    parser.add_argument("--tables", required=True, help="folder of the base tables")
    parser.add_argument("--out", required=True, help="folder of the results")
    parser.add_argument("--marts", help="folder of the stored marts")
    parser.add_argument("--refresh-marts", action="store_true", help="rebuild the marts first")
    parser.add_argument("--list-reports", action="store_true", help="derive the reports from the flags")
    parser.add_argument("--only-file", help="only the report with this file name")
    parser.add_argument(
        "--param", action="append", default=[], metavar="NAME=VALUE",
        help="a field of Params, as often as needed; lists are comma-separated",
    )
    return parser.parse_args(argv)


def settings(given: list[str]) -> Params:
    """``Params`` with the ``name=value`` texts in ``given``, read as the default's type."""
    defaults, values = {f.name: f.default for f in fields(Params)}, {}
    for item in given:
        name, _, value = item.partition("=")
        if name not in defaults:
            raise ValueError(f"no such setting: {item}")
        default = defaults[name]
        values[name] = (
            tuple(v.strip() for v in value.split(",") if v.strip())
            if isinstance(default, tuple) else type(default)(value)
        )
    return Params(**values)


def prepare(spark: SparkSession, args: argparse.Namespace, params: Params | None = None) -> Workspace:
    ws = Workspace(read_parquet(spark, args.tables), params or settings(args.param))
    if args.marts and args.refresh_marts:
        refresh_marts(ws, args.marts)
    if args.marts:
        ws = with_stored_marts(ws, args.marts)
    if args.list_reports:
        # Written once: every section reads the list, and deriving it scans the facts.
        columns = ["report_id", "desc_source", "nom_fichier", "list_import"]
        report_list(ws).select(columns).write.mode("overwrite").parquet(f"{args.out}/report_list")
        ws = ws.with_reports(spark.read.parquet(f"{args.out}/report_list"))
    if args.only_file is not None:
        ws = ws.with_reports(select_reports(ws.tables.report, args.only_file))
    return ws


def main(argv: list[str] | None = None) -> int:
    args, start = arguments(argv), time.monotonic()
    builder = SparkSession.builder.appName("lotscope")
    for key, value in SESSION_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    try:
        ws = prepare(spark, args)
    except Exception:
        log.exception("the marts could not be prepared")
        return 1
    outcome = run_reports(ws, args.out)
    log.info(
        "%d reports in %.1f s, failed sections: %s, failed reports: %d",
        outcome.reports, time.monotonic() - start, ", ".join(outcome.failed_sections) or "none",
        len(outcome.failed_reports),
    )
    return outcome.exit_code


if __name__ == "__main__":
    raise SystemExit(main())
