"""Producing every section of every report and writing them out.

All reports are computed together, section by section; only where that fails are the reports
that fail searched for.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.functions.text import safe_file_name
from lotscope.operators.summary import report_summary
from lotscope.plans.sections import SECTIONS, Section
from lotscope.workspace import Workspace

log = logging.getLogger(__name__)

STATUS_SCHEMA = "section string, report_id string, ok boolean, error string"
#: Before the first column's name, so that each file begins with the mark of UTF-8, without
#: which spreadsheets misread accents.
UTF8_MARK = "\ufeff"
#: Of the hash that halves the reports.
LAST_BIT = 63


@dataclass(frozen=True)
class Outcome:
    """``failed_reports`` are those that lack a section which other reports have."""

    reports: int
    failed_sections: tuple[str, ...]
    failed_reports: tuple[str, ...] = ()

    @property
    def exit_code(self) -> int:
        return 2 if self.failed_sections else 0


def output_names(ws: Workspace) -> DataFrame:
    """Safe output name of each report: its file name, else its description."""
    given = F.when(F.col("nom_fichier") != "", F.col("nom_fichier"))
    return ws.tables.report.select(
        "report_id", safe_file_name(F.coalesce(given, F.col("desc_source"))).alias("fichier")
    ).distinct()


def _by_report(df: DataFrame, names: DataFrame, ordering: list[Column]) -> DataFrame:
    """With the output name, brought together by it: few files per report, while a report
    holding most of the rows is still split over several tasks.  Each file is in order."""
    named = df.join(names, "report_id").hint("rebalance", F.col("fichier"))
    return named.sortWithinPartitions("fichier", "report_id", *ordering)


def write_section(section: Section, df: DataFrame, names: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, one folder per report."""
    if section.per_report:
        _by_report(df, names, section.ordering).write.mode(mode).partitionBy("fichier").parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def export_duplicates(groups: DataFrame, names: DataFrame, path: str, ordering: list[Column] = ()) -> None:
    """Duplicate groups as CSV with a header, one folder per safe name; ``report_id`` tells
    apart reports that share one."""
    named = _by_report(groups, names, list(ordering)).withColumnRenamed("report_id", UTF8_MARK + "report_id")
    named.write.mode("overwrite").option("header", True).partitionBy("fichier").csv(path)


def _halves(ws: Workspace, bit: int) -> list[Workspace]:
    """The workspace with either half of its reports, by a bit of the identifier's hash."""
    report = ws.tables.report
    side = F.shiftright(F.xxhash64("report_id"), bit).bitwiseAND(F.lit(1))
    return [ws.with_reports(report.filter(side == i)) for i in (0, 1)]


def _write_apart(section: Section, ws: Workspace, names: DataFrame, path: str, bit: int) -> list[tuple[str, str]]:
    """Append the section of both halves of the reports; a half that fails is cut again.
    Returns the reports that fail by themselves, with their errors."""
    failed = []
    for half in _halves(ws, bit):
        ids = [r[0] for r in half.tables.report.select("report_id").distinct().limit(2).collect()]
        if not ids:
            continue
        try:
            write_section(section, section.build(half), names, path, "append")
        except Exception as error:
            if len(ids) == 1 or bit == LAST_BIT:
                log.error("report %s: %s", ids[0], error)
                failed += [(i, str(error)) for i in ids]
            else:
                failed += _write_apart(section, half, names, path, bit + 1)
    return failed


def produce(name: str, section: Section, ws: Workspace, names: DataFrame, path: str) -> list[tuple]:
    """Write a section of all reports in one job, and return its rows of the status table.

    If that fails, the reports are halved until those that fail stand alone, and the others
    are written: about two runs for each halving and failing report.  A section that can't
    even be planned, or has no reports, is left empty as a whole.  What an earlier run left
    at ``path`` is gone either way, as the status then says.
    """
    try:
        write_section(section, section.build(ws), names, path)
        return [(name, None, True, None)]
    except Exception as error:
        log.exception("section %s failed", name)
        whole = str(error)
    write_section(section, section.empty(ws.tables.observation.sparkSession), names, path)
    if not section.per_report or not _plannable(section, ws):
        return [(name, None, False, whole)]
    return [(name, report, False, error) for report, error in _write_apart(section, ws, names, path, 0)] or [
        (name, None, True, None)
    ]


def _plannable(section: Section, ws: Workspace) -> bool:
    """Whether the section can be built for no reports at all."""
    try:
        section.build(ws.with_reports(ws.tables.report.filter(F.lit(False)))).schema  # noqa: B018
    except Exception:
        return False
    return True


def run_reports(ws: Workspace, out: str, only: list[str] | None = None) -> Outcome:
    """Write all sections, the duplicates export, the summary and the status table.

    What fails is recorded: the section of one report where only that fails, else the whole
    section.  Everything else is written.
    """
    spark = ws.tables.observation.sparkSession
    if ws.tables.report.isEmpty():
        log.warning("no report to produce")
        return Outcome(0, ())
    names, status = ws.small(output_names(ws)), []
    for name in only or SECTIONS:
        status += produce(name, SECTIONS[name], ws, names, f"{out}/{name}")
    written = {
        name: spark.read.schema(SECTIONS[name].schema).parquet(f"{out}/{name}")
        for name in only or SECTIONS
    }
    if "dup_within" in written:
        export_duplicates(written["dup_within"], names, f"{out}/duplicates_csv", SECTIONS["dup_within"].ordering)
    if only is None:
        report_summary(ws, written).write.mode("overwrite").parquet(f"{out}/report_summary")
    spark.createDataFrame(status, STATUS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
        f"{out}/section_status"
    )
    failed = [(section, report) for section, report, ok, _ in status if not ok]
    return Outcome(
        ws.tables.report.select("report_id").distinct().count(),
        tuple(dict.fromkeys(section for section, _ in failed)),
        tuple(sorted({report for _, report in failed if report is not None})),
    )
