"""Distribution over taxonomic ranks and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotscope.functions.text import same_code
from lotscope.model import SPECIES_RANK
from lotscope.workspace import Workspace


def rank_shares(ws: Workspace) -> DataFrame:
    """Observations by rank: share within the report and within the whole base.

    Windows run over one row per rank, after aggregation.
    """
    mart = ws.mart("rank")
    base = mart.groupBy("nom_rang").agg(F.sum("nb_data").alias("of_rank"))
    everything = mart.agg(F.sum("nb_data").alias("n")).scalar()
    shares = base.select(
        "nom_rang", F.try_divide("of_rank", everything).alias("repartition_total")
    )
    in_report = Window.partitionBy("report_id")
    return (
        ws.per_report(mart)
        .groupBy("report_id", "nom_rang")
        .agg(F.sum("nb_data").alias("nb_data"))
        .withColumn("part_data", F.try_divide("nb_data", F.sum("nb_data").over(in_report)))
        .join(shares, "nom_rang", "left")
        .select(
            "report_id", F.col("nom_rang").alias("rang"), "nb_data", "part_data", "repartition_total"
        )
        .orderBy("report_id", F.desc("nb_data"), "rang")
    )


def _species(ws: Workspace) -> DataFrame:
    species = ws.mart("detail").filter(same_code(F.col("id_rang"), SPECIES_RANK))
    return ws.per_report(species).withColumnRenamed("group2_inpn", "groupe_taxo")


def species_by_group(ws: Workspace) -> DataFrame:
    return (
        _species(ws)
        .groupBy("report_id", "groupe_taxo")
        .agg(F.count_distinct("cd_ref").alias("nb_esp"))
        .orderBy("report_id", F.asc_nulls_last("groupe_taxo"))
    )


def records_by_group(ws: Workspace) -> DataFrame:
    return (
        _species(ws)
        .groupBy("report_id", "groupe_taxo")
        .agg(F.sum("nb_data").alias("nb_data"))
        .orderBy("report_id", F.asc_nulls_last("groupe_taxo"))
    )


def fold_small(
    df: DataFrame,
    label: str,
    value: str,
    share: float = 0.02,
    keep: int = 10,
    other: str = "Autres",
    by: str = "report_id",
) -> DataFrame:
    """Merge the small categories of each report into one, listed last.

    Small means under ``share`` of the total or past the first ``keep`` by value
    (ties in order of the label).  A single small category, or a total of zero, is
    left alone.  ``position`` is the order of display.
    """
    whole = Window.partitionBy(by)
    ranked = whole.orderBy(F.desc(value), F.asc_nulls_last(label))
    marked = (
        df.select(by, label, value)
        .withColumn("total", F.sum(value).over(whole))
        .withColumn("position", F.row_number().over(ranked))
        .withColumn(
            "small",
            F.coalesce(F.try_divide(value, "total") < share, F.lit(False))
            | (F.col("position") > keep),
        )
        .withColumn("folded", F.sum(F.col("small").cast("int")).over(whole))
        .withColumn("merge", F.col("small") & (F.col("folded") > 1) & (F.col("total") != 0))
    )
    return (
        marked.groupBy(
            by,
            "merge",
            F.when(F.col("merge"), 0).otherwise(F.col("position")).alias("slot"),
        )
        .agg(
            F.first(F.when(~F.col("merge"), F.col(label))).alias("kept"),
            F.sum(value).alias(value),
            F.min("position").alias("position"),
        )
        .select(
            by,
            F.when(F.col("merge"), other).otherwise(F.col("kept")).alias(label),
            value,
            F.when(F.col("merge"), F.lit(keep + 1)).otherwise(F.col("position")).alias("position"),
        )
        .orderBy(by, "position")
    )


def folded_species(ws: Workspace) -> DataFrame:
    p = ws.params
    return fold_small(
        species_by_group(ws), "groupe_taxo", "nb_esp", p.fold_share, p.fold_keep, p.fold_label
    )


def folded_records(ws: Workspace) -> DataFrame:
    p = ws.params
    return fold_small(
        records_by_group(ws), "groupe_taxo", "nb_data", p.fold_share, p.fold_keep, p.fold_label
    )
