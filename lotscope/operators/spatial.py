"""Mesh map, records outside the region, altitudes, kinds and sizes of geometries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.functions import geometry as geo
from lotscope.functions.projection import LAMBERT93
from lotscope.model import Params
from lotscope.operators import area_index
from lotscope.workspace import Workspace


def mesh_choropleth(ws: Workspace) -> DataFrame:
    """Cells of the mesh with their observations.  ``nb_esp`` is the largest number of
    names in any one lot, not in their union."""
    cells = ws.mart("mesh").select(
        "id_area", "lot_id", "nb_data", F.size("tab_lb_nom").alias("names")
    )
    shapes = ws.tables.area.select("id_area", geo.geojson(F.col("geom_4326")).alias("geojson"))
    return (
        ws.per_report(cells)
        .groupBy("report_id", "id_area")
        .agg(F.sum("nb_data").alias("nb_data"), F.max("names").alias("nb_esp"))
        .join(shapes, "id_area")
        .select("report_id", "id_area", "geojson", "nb_data", "nb_esp")
    )


def regions(ws: Workspace) -> DataFrame:
    return ws.tables.area.filter(F.col("area_name").ilike(ws.params.region_pattern))


def outside_region(ws: Workspace) -> DataFrame:
    """Observations whose centroid is more than the margin away from the region (the
    matching area with the lowest identifier).  Without a geometry, or without a
    region, nothing is known and nothing is reported."""
    p = ws.params
    region = regions(ws).orderBy("id_area").limit(1)
    index = area_index.build(region, "id_area", p.index_cell_m, p.region_margin_m, p.broadcast_rows)
    x, y = F.col("x"), F.col("y")
    rows = ws.reported(
        ws.observation.select(
            "id_synthese", "lot_id", "id_source", "id_import", "nom_cite",
            F.col("date_max").cast("date").alias("date_max"), "observers", "geom",
        ).filter(F.col("geom.kind").isNotNull())
    )
    located = (
        geo.evaluated(rows, geo.centroid(F.col("geom")), "x", "y")
        .drop("geom")
        .withColumns(index.cell_of(x, y))
    )
    far = (
        located.join(index.cells.drop("id_area"), ["cx", "cy"], "left")
        .filter(~index.hit_point(x, y) & F.lit(index.extent is not None))
    )
    return ws.per_report(far).select(
        "report_id", "id_synthese",
        LAMBERT93.lat(x, y).alias("lat"),
        LAMBERT93.lon(x, y).alias("lon"),
        "id_source", "id_import", "nom_cite", "date_max", "observers",
    )


# Class limits in metres and the bounds of a believable altitude.
# Below 2500 the minimum decides the class, from there on the maximum does.
FIRST_LIMITS = (0, 40, 250)
STEP = 250
LAST_BY_MIN = 2500
LAST_BY_MAX = 4750
LOWEST, HIGHEST = 40, 4750
NO_DATA, OTHER = -1, -2


def altitude_classes() -> dict[int, str]:
    """Order of display to label."""
    limits = [*FIRST_LIMITS, *range(FIRST_LIMITS[-1] + STEP, LAST_BY_MAX + 1, STEP)]
    labels = {0: f"< {limits[0]}"}
    for order, (low, high) in enumerate(zip(limits, limits[1:]), start=1):
        labels[order] = f"{low}-{high}"
    labels[len(limits)] = f"> {LAST_BY_MAX}"
    labels[NO_DATA] = "Sans donnees"
    labels[OTHER] = "Autres"
    return labels


def altitude_order(low: Column, high: Column) -> Column:
    limits = [*FIRST_LIMITS, *range(FIRST_LIMITS[-1] + STEP, LAST_BY_MAX + 1, STEP)]
    order = F.when(F.lit(False), 0)
    for position, limit in enumerate(limits):
        order = order.when((low if limit <= LAST_BY_MIN else high) < limit, position)
    return (
        order.when(high > LAST_BY_MAX, len(limits))
        .when(low.isNull() | high.isNull(), NO_DATA)
        .otherwise(OTHER)
    )


def labelled(order: Column, labels: dict[int, str]) -> Column:
    chosen = F.when(F.lit(False), "")
    for value, label in labels.items():
        chosen = chosen.when(order == value, label)
    return chosen


def altitude_profile(ws: Workspace) -> DataFrame:
    """Observations by altitude class and validity.  Counted by lot and class number;
    labels come after."""
    low, high = F.col("altitude_min"), F.col("altitude_max")
    believable = low.between(LOWEST, HIGHEST) & high.between(LOWEST, HIGHEST)
    by_lot = (
        ws.reported(
            ws.observation.select(
                "lot_id",
                altitude_order(low, high).alias("classe_altitude_order"),
                F.coalesce(believable, F.lit(False)).alias("believable"),
            )
        )
        .groupBy("lot_id", "classe_altitude_order", "believable")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        ws.per_report(by_lot)
        .groupBy("report_id", "classe_altitude_order", "believable")
        .agg(F.sum("n").alias("tot_data"))
        .select(
            "report_id",
            labelled(F.col("classe_altitude_order"), altitude_classes()).alias("classe_altitude"),
            "classe_altitude_order",
            F.when(F.col("believable"), "correct").otherwise("incorrect").alias("validite"),
            "tot_data",
        )
        .orderBy("report_id", "classe_altitude_order")
    )


def altitude_alert(ws: Workspace) -> DataFrame:
    return (
        altitude_profile(ws)
        .filter(F.col("validite") == "incorrect")
        .groupBy("report_id")
        .agg(F.sum("tot_data").alias("nb_data_hors_altitude"))
    )


def geometry_types(ws: Workspace) -> DataFrame:
    """Observations by source, import and family of geometry."""
    kind = F.col("geom.kind")
    family = (
        F.when(kind.isin(*geo.LINE_KINDS), "Lignes")
        .when(kind.isin(*geo.POLYGON_KINDS), "Polygones")
        .when(kind.isin(*geo.POINT_KINDS), "Points")
        .when(kind.isNull(), "Sans geometrie")
        .otherwise("Autre")
    )
    by_lot = (
        ws.reported(
            ws.observation.select("lot_id", "id_source", "id_import", family.alias("type_geom"))
        )
        .groupBy("lot_id", "id_source", "id_import", "type_geom")
        .agg(F.count(F.lit(1)).alias("nb_data"))
    )
    return ws.per_report(by_lot).select(
        "report_id", "id_source", "id_import", "type_geom", "nb_data"
    )


def geometry_types_total(ws: Workspace) -> DataFrame:
    return (
        geometry_types(ws)
        .groupBy("report_id", "type_geom")
        .agg(F.sum("nb_data").alias("nb_data"))
    )


def size_limits(params: Params) -> dict[str, list[tuple[float, str]]]:
    """Upper limits and labels of the size classes; the last class is open."""
    km, ha = params.line_limit_km, params.area_limit_ha
    return {
        "Lignes": [
            (100.0, "< 100 m"),
            (1000.0, "100 m - 1 km"),
            (5000.0, "1 - 5 km"),
            (km * 1000, f"5 - {km:g} km"),
            (float("inf"), f"> {km:g} km"),
        ],
        "Polygones": [
            (1000.0, "< 0,1 ha"),
            (10000.0, "0,1 - 1 ha"),
            (100000.0, "1 - 10 ha"),
            (1000000.0, "10 - 100 ha"),
            (ha * 10000, f"100 - {ha:g} ha"),
            (float("inf"), f"> {ha:g} ha"),
        ],
    }


def geometry_sizes(ws: Workspace) -> DataFrame:
    """Lines by length and polygons by surface; ``imprecise`` marks those at or above
    the configured limit."""
    kind, g, size = F.col("geom.kind"), F.col("geom"), F.col("size")
    limits = size_limits(ws.params)
    order = F.when(F.lit(False), 0)
    label = F.when(F.lit(False), "")
    for family, classes in limits.items():
        for position, (limit, text) in enumerate(classes, start=1):
            own = F.col("type_geom") == family
            order = order.when(own & ((size < limit) | F.lit(limit == float("inf"))), position)
            label = label.when(own & (F.col("classe_order") == position), text)
    threshold = labelled_number(F.col("type_geom"), {k: v[-2][0] for k, v in limits.items()})
    by_lot = (
        ws.reported(
            ws.observation.select("lot_id", "geom").filter(
                kind.isin(*geo.LINE_KINDS, *geo.POLYGON_KINDS)
            )
        )
        .select(
            "lot_id",
            F.when(kind.isin(*geo.LINE_KINDS), "Lignes").otherwise("Polygones").alias("type_geom"),
            F.when(kind.isin(*geo.LINE_KINDS), geo.length(g)).otherwise(geo.area(g)).alias("size"),
        )
        .select(
            "lot_id", "type_geom", order.alias("classe_order"), (size >= threshold).alias("imprecise")
        )
        .groupBy("lot_id", "type_geom", "classe_order", "imprecise")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        ws.per_report(by_lot)
        .groupBy("report_id", "type_geom", "classe_order", "imprecise")
        .agg(F.sum("n").alias("nb_data"))
        .select(
            "report_id", "type_geom", label.alias("classe_taille"), "classe_order", "imprecise", "nb_data"
        )
        .orderBy("report_id", "type_geom", "classe_order")
    )


def labelled_number(key: Column, values: dict[str, float]) -> Column:
    chosen = F.when(F.lit(False), F.lit(0.0))
    for name, value in values.items():
        chosen = chosen.when(key == name, F.lit(value))
    return chosen


def imprecise_total(ws: Workspace) -> DataFrame:
    """Counted by condition, not by filter: a filter would be pushed below the
    aggregates and measure every geometry a second time."""
    return (
        geometry_sizes(ws)
        .groupBy("report_id")
        .agg(F.sum(F.when(F.col("imprecise"), F.col("nb_data"))).alias("nb_geom_imprecise"))
        .filter("nb_geom_imprecise > 0")
    )
