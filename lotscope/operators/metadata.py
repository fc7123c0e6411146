"""Datasets and acquisition frameworks of each report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.workspace import Workspace


def dataset_table(ws: Workspace) -> DataFrame:
    """Observations by framework and dataset; datasets without a framework drop out."""
    frameworks = ws.mart("framework").select(
        "lot_id", "id_acquisition_framework", "acquisition_framework_name"
    )
    return (
        ws.per_report(
            ws.mart("dataset").join(frameworks, ["lot_id", "id_acquisition_framework"])
        )
        .groupBy("report_id", "acquisition_framework_name", "dataset_name", "unique_dataset_id")
        .agg(F.sum("nb_data").alias("nb_data"))
        .orderBy(
            "report_id",
            F.asc_nulls_last("acquisition_framework_name"),
            F.asc_nulls_last("dataset_name"),
        )
    )


def framework_table(ws: Workspace) -> DataFrame:
    return (
        ws.per_report(ws.mart("framework"))
        .groupBy("report_id", "unique_acquisition_framework_id", "acquisition_framework_name")
        .agg(F.sum("nb_data").alias("nb_data"))
        .orderBy("report_id", F.asc_nulls_last("acquisition_framework_name"))
    )
