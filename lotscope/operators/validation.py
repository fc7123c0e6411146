"""Validation status, latest validations and the records still to be reviewed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.functions.text import day_text
from lotscope.model import ADVISED_STATUS_CODES, STATUS_TYPE
from lotscope.workspace import Workspace


def latest_validation(ws: Workspace, records: DataFrame | None = None) -> DataFrame:
    """The validations dated as late as any of their record: ties are all kept, a
    missing record or date never matches.  With ``records`` (``uuid``), only theirs: the
    rest of the history goes before anything is aggregated.

    The latest date is found by a combining aggregate and joined back, not by a
    window: the history of one record, however long, is never gathered in one task.
    """
    history = ws.tables.validation
    columns = history.columns
    if records is not None:
        wanted = records.select(F.col("uuid").alias("uuid_attached_row"))
        history = history.join(wanted, "uuid_attached_row", "left_semi")
    latest = history.groupBy("uuid_attached_row").agg(
        F.max("validation_date").alias("validation_date")
    )
    return history.join(latest, ["uuid_attached_row", "validation_date"]).select(columns)


def nomenclature_id(ws: Workspace, type_code: str, code: str) -> Column:
    """Identifier of a nomenclature by type and code, NULL when there is none; a
    scalar subquery, evaluated once."""
    return (
        ws.tables.nomenclature.filter(
            (F.col("type_code") == type_code) & (F.col("cd_nomenclature") == code)
        )
        .agg(F.min("id_nomenclature"))
        .scalar()
    )


def _none_of(value: Column, ids: list[Column]) -> Column:
    """SQL ``NOT IN``: false or unknown as soon as one identifier is missing."""
    return reduce(lambda a, b: a & b, [value != i for i in ids])


def status_mix(ws: Workspace) -> DataFrame:
    """Observations by the label of their status, those without one included."""
    labels = ws.tables.nomenclature.select(
        F.col("id_nomenclature").alias("status"), F.col("label_default").alias("label_valid_status")
    )
    by_lot = (
        ws.reported(ws.observation.select("lot_id", F.col("id_nomenclature_valid_status").alias("status")))
        .groupBy("lot_id", "status")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(labels, "status", "left")
    )
    return (
        ws.per_report(by_lot)
        .groupBy("report_id", "label_valid_status")
        .agg(F.sum("n").alias("nb_data"))
        .orderBy("report_id", F.asc_nulls_last("label_valid_status"))
    )


def to_review(ws: Workspace) -> DataFrame:
    """Records whose latest validation has none of the advised statuses, with the
    label of the record's own status."""
    advised = [nomenclature_id(ws, STATUS_TYPE, code) for code in ADVISED_STATUS_CODES]
    records = ws.reported(
        ws.observation.select(
            F.col("unique_id_sinp").alias("uuid"),
            "lot_id",
            "cd_nom",
            F.col("id_nomenclature_valid_status").alias("status"),
        ).filter(F.col("status").isNotNull())
    )
    latest = (
        latest_validation(ws, records)
        .filter(_none_of(F.col("id_nomenclature_valid_status"), advised))
        .select(
            F.col("uuid_attached_row").alias("uuid"),
            F.col("validation_comment").alias("commentaire"),
            day_text(F.col("validation_date")).alias("date_commentaire"),
        )
    )
    labels = ws.tables.nomenclature.select(
        F.col("id_nomenclature").alias("status"), F.col("label_default").alias("label_valid_status")
    )
    taxa = ws.tables.taxref.select(
        "cd_nom", "cd_ref", "nom_vern", "lb_nom", F.rtrim("id_rang").alias("code")
    )
    ranks = ws.tables.rank_.select(F.rtrim("id_rang").alias("code"), F.col("nom_rang").alias("rang"))
    described = (
        records.join(latest, "uuid").join(labels, "status").join(taxa, "cd_nom").join(ranks, "code")
    )
    return ws.per_report(described).select(
        "report_id", "uuid", "cd_ref", "rang", "nom_vern", "lb_nom", "label_valid_status",
        "commentaire", "date_commentaire",
    )
