"""One row per report: key figures, alert counters and which parts have something to
show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.workspace import Workspace

# Counter to the flag that tells whether its part is shown.
FLAGS = {
    "nb_doublon": "show_doublon",
    "nb_source_doublon": "show_doublon_source",
    "nb_validation": "show_validation",
    "nb_data_hors_regions": "show_data_hors_regions",
    "nb_data_hors_altitude": "show_data_hors_altitude",
    "nb_data_mois_hors_plage": "show_data_mois_hors_plage",
    "nb_geom_imprecise": "show_geom_imprecise",
    "nb_nouvelles_eee": "show_eee",
}
KEY_FIGURES = ("nb_obs", "nb_taxon", "nb_esp", "nb_jdd", "nb_ca")


def report_summary(ws: Workspace, sections: dict[str, DataFrame]) -> DataFrame:
    """``sections`` maps names to section results, computed or read back from a sink;
    read back, nothing heavy is computed twice."""

    def rows(section: str, counter: str) -> DataFrame:
        return sections[section].groupBy("report_id").agg(F.count(F.lit(1)).alias(counter))

    altitudes = sections["altitude_profile"].filter(F.col("validite") == "incorrect")
    sizes = sections["geometry_sizes"]
    parts = [
        sections["kpi_totals"],
        sections["kpi_taxa"],
        rows("dup_within", "nb_doublon"),
        rows("dup_across", "nb_source_doublon"),
        rows("to_review", "nb_validation"),
        rows("outside_region", "nb_data_hors_regions"),
        altitudes.groupBy("report_id").agg(F.sum("tot_data").alias("nb_data_hors_altitude")),
        sizes.groupBy("report_id").agg(
            F.sum(F.when(F.col("imprecise"), F.col("nb_data"))).alias("nb_geom_imprecise")
        ),
        sections["implausible_dates"],
    ]
    reports = ws.tables.report.select("report_id").distinct()
    joined = reduce(lambda a, b: a.join(b, "report_id", "left"), parts, reports)
    # The same for every report: a scalar.
    found = (
        sections["invasive_summary"]
        .agg(F.count(F.when(F.col("nouvelle_presence") == "Oui", 1)))
        .scalar()
    )
    counted = joined.withColumn("nb_nouvelles_eee", found)
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in (*KEY_FIGURES, *FLAGS)]
    flags = [(F.coalesce(F.col(c), F.lit(0)) > 0).alias(flag) for c, flag in FLAGS.items()]
    dates = F.coalesce(F.col("dates_mois_hors_plage"), F.array().cast("array<string>"))
    return counted.select("report_id", *numbers, dates.alias("dates_mois_hors_plage"), *flags)
