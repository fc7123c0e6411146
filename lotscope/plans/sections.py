"""The sections of a report, each with the schema it promises."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotscope.operators import (
    duplicates, invasive, kpi, metadata, spatial, taxonomy, temporal, validation,
)
from lotscope.workspace import Workspace


@dataclass(frozen=True)
class Section:
    """``order``: columns by which a report's rows are stored, a descending one with a minus."""

    build: Callable[[Workspace], DataFrame]
    schema: str
    order: tuple[str, ...] = ()

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema)

    @property
    def per_report(self) -> bool:
        return self.schema.startswith("report_id ")

    @property
    def ordering(self) -> list[Column]:
        return [F.desc(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in self.order]


SECTIONS: dict[str, Section] = {
    "kpi_totals": Section(
        kpi.totals, "report_id string, nb_obs bigint, nb_jdd bigint, nb_ca bigint"
    ),
    "kpi_taxa": Section(kpi.taxa, "report_id string, nb_taxon bigint, nb_esp bigint"),
    "by_year": Section(temporal.by_year, "report_id string, an int, Donnees bigint", ("an",)),
    "by_month": Section(
        temporal.by_month,
        "report_id string, date2 string, date string, mois int, an int, Donnees bigint",
        ("an", "mois"),
    ),
    "ancient_rows": Section(
        temporal.ancient_rows, "report_id string, an int, mois int, Donnees bigint",
        ("an", "mois"),
    ),
    "implausible_dates": Section(
        temporal.implausible_dates,
        "report_id string, nb_data_mois_hors_plage bigint, dates_mois_hors_plage array<string>",
    ),
    "mesh_choropleth": Section(
        spatial.mesh_choropleth,
        "report_id string, id_area int, geojson string, nb_data bigint, nb_esp int",
    ),
    "outside_region": Section(
        spatial.outside_region,
        "report_id string, id_synthese bigint, lat double, lon double, id_source int, "
        "id_import int, nom_cite string, date_max date, observers string",
    ),
    "altitude_profile": Section(
        spatial.altitude_profile,
        "report_id string, classe_altitude string, classe_altitude_order int, "
        "validite string, tot_data bigint",
        ("classe_altitude_order", "validite"),
    ),
    "geometry_types": Section(
        spatial.geometry_types,
        "report_id string, id_source int, id_import int, type_geom string, nb_data bigint",
    ),
    "geometry_types_total": Section(
        spatial.geometry_types_total, "report_id string, type_geom string, nb_data bigint"
    ),
    "geometry_sizes": Section(
        spatial.geometry_sizes,
        "report_id string, type_geom string, classe_taille string, classe_order int, "
        "imprecise boolean, nb_data bigint",
        ("type_geom", "classe_order"),
    ),
    "rank_shares": Section(
        taxonomy.rank_shares,
        "report_id string, rang string, nb_data bigint, part_data double, repartition_total double",
        ("-nb_data", "rang"),
    ),
    "species_by_group": Section(
        taxonomy.species_by_group, "report_id string, groupe_taxo string, nb_esp bigint",
        ("groupe_taxo",),
    ),
    "records_by_group": Section(
        taxonomy.records_by_group, "report_id string, groupe_taxo string, nb_data bigint",
        ("groupe_taxo",),
    ),
    "folded_species": Section(
        taxonomy.folded_species,
        "report_id string, groupe_taxo string, nb_esp bigint, position int",
        ("position",),
    ),
    "folded_records": Section(
        taxonomy.folded_records,
        "report_id string, groupe_taxo string, nb_data bigint, position int",
        ("position",),
    ),
    "dataset_table": Section(
        metadata.dataset_table,
        "report_id string, acquisition_framework_name string, dataset_name string, "
        "unique_dataset_id string, nb_data bigint",
        ("acquisition_framework_name", "dataset_name"),
    ),
    "framework_table": Section(
        metadata.framework_table,
        "report_id string, unique_acquisition_framework_id string, "
        "acquisition_framework_name string, nb_data bigint",
        ("acquisition_framework_name",),
    ),
    "status_mix": Section(
        validation.status_mix, "report_id string, label_valid_status string, nb_data bigint"
    ),
    "to_review": Section(
        validation.to_review,
        "report_id string, uuid string, cd_ref int, rang string, nom_vern string, "
        "lb_nom string, label_valid_status string, commentaire string, date_commentaire string",
    ),
    "dup_within": Section(
        duplicates.within_report,
        "report_id string, cd_nom int, lb_nom string, nom_vern string, geom_type string, "
        "lat double, lon double, observers string, id_nomenclature_sex int, "
        "id_nomenclature_obs_technique int, count_max int, count_min int, "
        "id_nomenclature_life_stage int, date string, nb_data_similaire bigint",
        ("-nb_data_similaire",),
    ),
    "dup_across": Section(
        duplicates.across_lots,
        "report_id string, nom_source string, nombre_donnees_dupliquees bigint, nb_paires bigint",
        ("-nb_paires",),
    ),
    "invasive_summary": Section(
        invasive.summary,
        "nom_vern string, lb_nom string, cd_ref int, presence_connue string, "
        "secteur_obs string, nouvelle_presence string, nb_donnees bigint, "
        "premiere_observation timestamp_ntz, derniere_observation timestamp_ntz, "
        "effectif_min int, effectif_max int",
        ("-nb_donnees",),
    ),
    "invasive_points": Section(
        invasive.points,
        "nom_vern string, lb_nom string, cd_ref int, presence_connue string, "
        "secteur_obs string, lat double, lon double",
    ),
}


def sections(ws: Workspace, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Lazy section results of all reports at once."""
    return {name: SECTIONS[name].build(ws) for name in (names or SECTIONS)}
