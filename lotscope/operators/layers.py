"""What a map needs besides its rows: scale, bounds and drawable points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.functions import geometry as geo

# The columns each point layer shows.
POPUP_FIELDS = {
    "outside_region": ("id_synthese", "nom_cite", "date_max", "observers"),
    "dup_within": ("nom_vern", "lb_nom", "cd_nom", "date", "observers", "nb_data_similaire"),
    "invasive_points": ("nom_vern", "lb_nom", "secteur_obs"),
}


def mesh_bounds(choropleth: DataFrame) -> DataFrame:
    """Range of the counts of each report's mesh and the box around its cells;
    unreadable shapes count for the range only."""
    vertices = geo.geojson_vertices(F.col("geojson"))
    lons = F.transform(vertices, lambda v: v[0])
    lats = F.transform(vertices, lambda v: v[1])
    return choropleth.groupBy("report_id").agg(
        F.min("nb_data").alias("nb_data_min"),
        F.max("nb_data").alias("nb_data_max"),
        F.min(F.array_min(lons)).alias("lon_min"),
        F.min(F.array_min(lats)).alias("lat_min"),
        F.max(F.array_max(lons)).alias("lon_max"),
        F.max(F.array_max(lats)).alias("lat_max"),
    )


def point_layer(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The rows that have a position, with the columns to show."""
    return rows.dropna(subset=["lat", "lon"]).select(
        *[c for c in ("report_id",) if c in rows.columns], "lat", "lon", *fields
    )


def point_bounds(layer: DataFrame, by: tuple[str, ...] = ("report_id",)) -> DataFrame:
    """Box around the points; ``single_location`` when they all coincide."""
    return (
        layer.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("nb_points"),
            F.min("lat").alias("lat_min"),
            F.min("lon").alias("lon_min"),
            F.max("lat").alias("lat_max"),
            F.max("lon").alias("lon_max"),
        )
        .withColumn(
            "single_location",
            (F.col("lat_min") == F.col("lat_max")) & (F.col("lon_min") == F.col("lon_max")),
        )
    )
