"""Key figures of each report; a report without data has zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.functions.text import same_code
from lotscope.model import SPECIES_RANK
from lotscope.workspace import Workspace


def totals(ws: Workspace) -> DataFrame:
    """Observations, datasets and frameworks."""
    found = (
        ws.per_report(ws.mart("dataset"))
        .groupBy("report_id")
        .agg(
            F.sum("nb_data").alias("nb_obs"),
            F.count_distinct("id_dataset").alias("nb_jdd"),
            F.count_distinct("id_acquisition_framework").alias("nb_ca"),
        )
    )
    return ws.every_report(found, nb_obs=0, nb_jdd=0, nb_ca=0)


def taxa(ws: Workspace) -> DataFrame:
    """Reference taxa, and those among them that are species."""
    species = F.when(same_code(F.col("id_rang"), SPECIES_RANK), F.col("cd_ref"))
    found = (
        ws.per_report(ws.mart("detail"))
        .groupBy("report_id")
        .agg(
            F.count_distinct("cd_ref").alias("nb_taxon"),
            F.count_distinct(species).alias("nb_esp"),
        )
    )
    return ws.every_report(found, nb_taxon=0, nb_esp=0)
