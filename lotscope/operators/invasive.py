"""Invasive taxa: where they were seen and where that is new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.functions import geometry as geo
from lotscope.functions.projection import LAMBERT93
from lotscope.functions.text import fold_accents, joined_set
from lotscope.model import SECTOR_DEPARTMENTS, WHOLE_REGION_SECTOR
from lotscope.operators import area_index
from lotscope.operators.spatial import regions
from lotscope.workspace import Workspace

TAXON = ("nom_vern", "lb_nom", "cd_ref", "presence")


def sectors(ws: Workspace) -> DataFrame:
    """(``secteur``, ``geom``): departments of the two parts and the region itself, one
    row per polygon.  ``id_area`` with ``secteur`` identifies a row."""
    departments = ws.tables.area.filter(F.col("id_type") == ws.params.department_type)
    parts = [
        departments.filter(F.col("area_name").isin(*names)).select(
            F.lit(sector).alias("secteur"), "id_area", "geom"
        )
        for sector, names in SECTOR_DEPARTMENTS.items()
    ]
    whole = regions(ws).select(F.lit(WHOLE_REGION_SECTOR).alias("secteur"), "id_area", "geom")
    return reduce(DataFrame.unionByName, [*parts, whole])


def sightings(ws: Workspace) -> DataFrame:
    """Observations of listed taxa in the fixed lots, one row per sector met, or one
    without a sector.

    A taxon is listed by any of its names, but only observations filed under its
    reference name are found.  A geometry spread over several cells may repeat a
    sector; every measure taken from these rows ignores repetition.
    """
    p = ws.params
    listed = (
        ws.tables.invasive.join(ws.tables.taxref, "cd_nom")
        .filter(F.col("cd_ref").isNotNull())
        .select(F.col("cd_ref").alias("cd_nom"), *TAXON)
    )
    seen = (
        ws.observation.filter(F.col("lot_id").isin(*p.invasive_lots))
        .select(
            "id_synthese", "cd_nom", "date_min", "date_max", "count_min", "count_max", "geom"
        )
        .join(ws.small(listed), "cd_nom")
    )
    zones = sectors(ws).withColumn("zone", F.struct("secteur", "id_area"))
    index = area_index.build(zones, "zone", p.index_cell_m, 0.0, p.broadcast_rows)
    met = index.hit_geometry(F.col("geom"))
    return (
        index.cells_of(seen, "geom")
        .join(index.cells, ["cx", "cy"], "left")
        .withColumn("secteur_spatial", F.when(met, F.col("zone.secteur")))
        .drop("cx", "cy", "zone", "inside", "near", "strip")
    )


def _in_sector(name: str) -> Column:
    return F.max(F.coalesce(F.col("secteur_spatial") == name, F.lit(False)))


def _observed_sectors() -> Column:
    """Sorted sectors other than the whole region, NULL when there are none."""
    sector = F.col("secteur_spatial")
    return joined_set(F.collect_set(F.when(sector != WHOLE_REGION_SECTOR, sector)))


def new_presence(presence: Column, in_ra: Column, in_au: Column) -> Column:
    """Seen in a part where the taxon was not known.  Unknown presence is not new."""
    return (
        F.when(F.lower(presence) == WHOLE_REGION_SECTOR.lower(), "Non")
        .when((presence == "RA") & in_au, "Oui")
        .when((presence == "Au") & in_ra, "Oui")
        .when(presence == "Absente", "Oui")
        .otherwise("Non")
    )


def summary(ws: Workspace) -> DataFrame:
    """One row per listed taxon.  The fixed lots do not depend on the report."""
    return (
        sightings(ws)
        .groupBy(*TAXON)
        .agg(
            _observed_sectors().alias("secteur_obs"),
            _in_sector("RA").alias("in_ra"),
            _in_sector("Au").alias("in_au"),
            F.count_distinct("id_synthese").alias("nb_donnees"),
            F.min("date_min").alias("premiere_observation"),
            F.max("date_max").alias("derniere_observation"),
            F.min("count_min").alias("effectif_min"),
            F.max("count_max").alias("effectif_max"),
        )
        .select(
            "nom_vern", "lb_nom", "cd_ref", F.col("presence").alias("presence_connue"),
            "secteur_obs",
            new_presence(F.col("presence"), F.col("in_ra"), F.col("in_au")).alias("nouvelle_presence"),
            "nb_donnees", "premiere_observation", "derniere_observation",
            "effectif_min", "effectif_max",
        )
        .orderBy(F.desc("nb_donnees"))
    )


def points(ws: Workspace) -> DataFrame:
    """One row per listed taxon and distinct geometry, at its centroid."""
    x, y = F.col("x"), F.col("y")
    found = sightings(ws).groupBy(*TAXON, "geom").agg(_observed_sectors().alias("secteur_obs"))
    return geo.evaluated(found, geo.centroid(F.col("geom")), "x", "y").select(
        "nom_vern", "lb_nom", "cd_ref", F.col("presence").alias("presence_connue"),
        "secteur_obs", LAMBERT93.lat(x, y).alias("lat"), LAMBERT93.lon(x, y).alias("lon"),
    )


def new_presence_count(ws: Workspace) -> DataFrame:
    """Number of new presences and whether their section is shown."""
    return (
        summary(ws)
        .agg(F.count(F.when(F.col("nouvelle_presence") == "Oui", 1)).alias("nb_nouvelles_eee"))
        .withColumn("show_eee", F.col("nb_nouvelles_eee") > 0)
    )
