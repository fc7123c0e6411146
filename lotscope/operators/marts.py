"""The six pre-aggregated marts.

Every mart counts observations by surrogate keys first and joins its dimensions to
the counts.  ``id_synthese`` is the primary key of the observations, so counting
rows is counting observations; the imports joined by their own key add no rows and
are joined only where a column of theirs is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.functions import text
from lotscope.model import Params
from lotscope.workspace import Workspace

LOT = ("id_source", "id_import")


def _with_lot(df: DataFrame) -> DataFrame:
    return df.withColumn("lot_id", text.lot_id(F.col("id_source"), F.col("id_import")))


def _total() -> Column:
    return F.sum("nb_data").alias("nb_data")


def described_source(params: Params, import_data: str, source_description: str) -> Column:
    """The import's own description for the import module, else the source's."""
    return F.when(
        F.col("id_source") == params.import_source_id,
        text.json_text(F.col(import_data), "desc_source"),
    ).otherwise(F.col(source_description))


def framework(ws: Workspace) -> DataFrame:
    """Lot x acquisition framework."""
    links = ws.tables.dataset.select("id_dataset", "id_acquisition_framework")
    return _with_lot(
        ws.counts(*LOT, "id_dataset")
        .join(links, "id_dataset")
        .groupBy(*LOT, "id_acquisition_framework")
        .agg(_total())
        .join(ws.tables.framework, "id_acquisition_framework")
    ).select(
        *LOT, "lot_id", "acquisition_framework_name", "acquisition_framework_desc",
        "unique_acquisition_framework_id", "id_acquisition_framework", "nb_data",
    )


def dataset(ws: Workspace) -> DataFrame:
    """Lot x dataset, with its address and its three sharing flags."""
    data = F.col("additional_data")
    return _with_lot(
        ws.counts(*LOT, "id_dataset").join(ws.tables.dataset, "id_dataset")
    ).select(
        *LOT, "lot_id", "id_acquisition_framework", "unique_dataset_id", "dataset_name",
        "dataset_desc", "id_dataset", "nb_data",
        F.concat(F.lit(ws.params.dataset_url), F.col("id_dataset").cast("string")).alias("url_jdd"),
        text.json_flag(data, "to_pole_vert").alias("pole_vert"),
        text.json_flag(data, "to_pole_inv").alias("pole_inv"),
        text.json_flag(data, "to_pifh").alias("pifh"),
    )


def detail(ws: Workspace) -> DataFrame:
    """Lot x source description x reference taxon."""
    taxa = ws.tables.taxref.select("cd_nom", "cd_ref", "id_rang", "group2_inpn")
    sources = ws.tables.source.select("id_source", "name_source", "desc_source")
    imports = ws.tables.import_.select("id_import", F.col("additional_data").alias("import_data"))
    return _with_lot(
        ws.counts(*LOT, "cd_nom")
        .join(taxa, "cd_nom")
        .groupBy(*LOT, "cd_ref", "id_rang", "group2_inpn")
        .agg(_total())
        .join(sources, "id_source")
        .join(imports, "id_import", "left")
    ).select(
        *LOT, "lot_id", "name_source", "desc_source",
        described_source(ws.params, "import_data", "desc_source").alias("desc_source_final"),
        "nb_data", "cd_ref", "id_rang", "group2_inpn",
    )


def mesh(ws: Workspace) -> DataFrame:
    """Lot x mesh cell: observations and the set of taxon names, a missing name being
    one element of it.

    Links to other areas are dropped before the one large join, and taxa are counted
    by key before their names are looked up and collected.
    """
    kinds = ws.tables.area_type.filter(F.col("type_code") == ws.params.mesh_type)
    areas = ws.tables.area.join(F.broadcast(kinds.select("id_type").limit(1)), "id_type")
    links = ws.tables.cor_area.select("id_synthese", "id_area").join(ws.small(areas.select("id_area")), "id_area")
    # A repeated link counts once; the join needs the links by observation in any case.
    links = links.repartition("id_synthese").dropDuplicates(["id_synthese", "id_area"])
    by_taxon = (
        ws.observation.select("id_synthese", *LOT, "cd_nom")
        .join(links, "id_synthese")
        .groupBy("id_area", *LOT, "cd_nom")
        .agg(F.count(F.lit(1)).alias("nb_data"))
    )
    cells = (
        by_taxon.join(ws.tables.taxref.select("cd_nom", "lb_nom"), "cd_nom", "left")
        .groupBy("id_area", *LOT)
        .agg(_total(), F.collect_set(F.struct("lb_nom")).alias("names"))
    )
    return _with_lot(cells).select(
        "id_area", *LOT, "lot_id", "nb_data",
        F.col("names")["lb_nom"].alias("tab_lb_nom"),
    ).join(areas.select("id_area", "geom_4326"), "id_area")


def temporal(ws: Workspace) -> DataFrame:
    """Lot x year x month of the start date, for known taxa."""
    return _with_lot(
        ws.counts(*LOT, "cd_nom", "annee", "mois")
        .join(ws.tables.taxref.select("cd_nom"), "cd_nom", "left_semi")
        .groupBy(*LOT, "annee", "mois")
        .agg(_total())
    ).select(*LOT, "lot_id", "nb_data", "annee", "mois")


def rank(ws: Workspace) -> DataFrame:
    """Lot x taxonomic rank."""
    taxa = ws.tables.taxref.select("cd_nom", F.rtrim("id_rang").alias("code"))
    ranks = ws.tables.rank_.select(F.rtrim("id_rang").alias("code"), "nom_rang")
    return _with_lot(
        ws.counts(*LOT, "cd_nom")
        .join(taxa, "cd_nom")
        .groupBy(*LOT, "code")
        .agg(_total())
        .join(ranks, "code")
        .groupBy(*LOT, "nom_rang")
        .agg(_total())
    ).select(*LOT, "lot_id", "nom_rang", "nb_data")


# In the order in which they are refreshed.
MARTS: dict[str, Callable[[Workspace], DataFrame]] = {
    "mesh": mesh,
    "dataset": dataset,
    "detail": detail,
    "framework": framework,
    "rank": rank,
    "temporal": temporal,
}
