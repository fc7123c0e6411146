"""Distribution over years and months, and the dates that cannot be right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.workspace import Workspace


def _summed(ws: Workspace, keep: Column | None, *keys: str) -> DataFrame:
    mart = ws.mart("temporal")
    rows = mart if keep is None else mart.filter(keep)
    return ws.per_report(rows).groupBy("report_id", *keys).agg(F.sum("nb_data").alias("Donnees"))


def by_year(ws: Workspace) -> DataFrame:
    return _summed(ws, None, "annee").select(
        "report_id", F.col("annee").alias("an"), "Donnees"
    ).orderBy("report_id", F.asc_nulls_last("an"))


def monthly(ws: Workspace) -> DataFrame:
    """All months from ``ancient_year`` on."""
    year, month = F.col("annee").cast("string"), F.col("mois").cast("string")
    return _summed(ws, F.col("annee") >= ws.params.ancient_year, "annee", "mois").select(
        "report_id",
        F.concat(year, F.lit("-"), F.lpad(month, 2, "0")).alias("date2"),
        F.concat(year, F.lit("-"), month).alias("date"),
        "mois",
        F.col("annee").alias("an"),
        "Donnees",
    )


def _plausible(ws: Workspace) -> Column:
    """Year not below the threshold and a month a nanosecond timestamp can hold; the
    zero-padded text sorts as the month does."""
    return (
        (F.col("an") >= ws.params.min_year)
        & F.try_to_timestamp("date2", F.lit("yyyy-MM")).isNotNull()
        & F.col("date2").between(ws.params.first_month, ws.params.last_month)
    )


def by_month(ws: Workspace) -> DataFrame:
    """The plausible months, for the monthly chart."""
    return monthly(ws).filter(_plausible(ws)).orderBy("report_id", "an", "mois")


def ancient_rows(ws: Workspace) -> DataFrame:
    """Months before ``ancient_year``."""
    return _summed(ws, F.col("annee") < ws.params.ancient_year, "annee", "mois").select(
        "report_id", F.col("annee").alias("an"), "mois", "Donnees"
    ).orderBy("report_id", "an", "mois")


def implausible_dates(ws: Workspace) -> DataFrame:
    """How many observations the monthly chart leaves out, and their months, sorted
    as text."""
    return (
        monthly(ws)
        .filter(~_plausible(ws))
        .groupBy("report_id")
        .agg(
            F.sum("Donnees").alias("nb_data_mois_hors_plage"),
            F.array_sort(F.collect_set("date")).alias("dates_mois_hors_plage"),
        )
    )
