"""The list of reports to produce and the lots each covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.functions import text
from lotscope.workspace import Workspace


def report_list(ws: Workspace) -> DataFrame:
    """Imports flagged for a report, grouped by their description, and flagged
    sources, which cover only their observations without an import.

    The observations are reduced to their distinct lots first.  The two branches
    never yield the same row (only the second lists lots that end in ``_``), so their
    union needs no further removal of duplicates.
    """
    lots = ws.counts("id_source", "id_import").select("id_source", "id_import")

    def flagged(df: DataFrame) -> DataFrame:
        return df.filter(text.json_text(F.col("additional_data"), "create_rapport") == "true")

    def quoted(*columns):
        return text.concat_skipping_null(F.lit("'"), *columns, F.lit("'"))

    imports = flagged(ws.tables.import_).select(
        "id_import",
        F.col("date_create_import").alias("last_date"),
        text.json_text(F.col("additional_data"), "desc_source").alias("desc_source"),
    )
    sources = flagged(ws.tables.source).select(
        "id_source", F.col("meta_update_date").alias("last_date"), "desc_source"
    )
    by_import = lots.join(imports, "id_import").select(
        F.lit("import").alias("origin"), "desc_source", "last_date",
        quoted(F.col("id_source"), F.lit("_"), F.col("id_import")).alias("lot"),
    )
    by_source = lots.join(sources, "id_source").select(
        F.lit("source").alias("origin"), "desc_source", "last_date",
        quoted(F.col("id_source"), F.lit("_")).alias("lot"),
    )
    name = text.report_file_name(F.col("desc_source"))
    return (
        by_import.unionByName(by_source)
        .groupBy("origin", "desc_source")
        .agg(F.max("last_date").alias("last_date"), F.collect_set("lot").alias("lots"))
        .select(
            text.concat_skipping_null(F.col("origin"), F.lit(":"), F.col("desc_source")).alias("report_id"),
            "desc_source",
            name.alias("nom_fichier"),
            "last_date",
            text.joined_set(F.col("lots")).alias("list_import"),
            text.report_address(name, ws.params.report_url).alias("url"),
        )
    )


def report_lots(ws: Workspace) -> DataFrame:
    return ws.report_lots


def select_reports(reports: DataFrame, file_name: str, mode: str = "exact") -> DataFrame:
    """Reports by file name: equal to it once trimmed, or containing it regardless
    of case."""
    wanted = file_name.strip()
    own = F.trim(F.col("nom_fichier"))
    if mode == "exact":
        return reports.filter(own == wanted)
    if mode == "contains":
        return reports.filter(F.contains(F.lower(own), F.lit(wanted.lower())))
    raise ValueError(f"unknown mode {mode!r}")
