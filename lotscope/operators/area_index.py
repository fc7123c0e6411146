"""Look-up of polygons by grid cell.

Joining observations to polygons by an equality on the cell they fall in replaces a
nested loop over whole polygons.  A cell entirely inside a polygon answers at once;
only cells near a boundary carry segments to test, and then just those nearby.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.functions import geometry as geo
from lotscope.functions.storing import stored

# Widens the reach when cells are assigned, so that rounding never loses one.
_SLACK = 1e-6


def _span(low: Column, high: Column, size: float) -> Column:
    first, last = F.floor(low / size), F.floor(high / size)
    return F.when(first <= last, F.sequence(first, last))


@dataclass(frozen=True)
class AreaIndex:
    """``cells``: one row per (area, cell) that is not outside, with ``cx``, ``cy``,
    ``inside``, the ``near`` segments and those crossing the same ``strip`` (row of
    cells).  ``extent`` is the bounding box of all areas, None without any."""

    cells: DataFrame
    size: float
    reach: float
    extent: tuple[float, float, float, float] | None

    # -- the cells of the looked-up side ------------------------------------

    def cell_of(self, x: Column, y: Column) -> dict[str, Column]:
        return {"cx": F.floor(x / self.size), "cy": F.floor(y / self.size)}

    def cells_of(self, df: DataFrame, geom: str) -> DataFrame:
        """One row per cell under the geometry's bounding box.  Cells beyond the extent
        of the areas match nothing and are not generated; a row without any cell stays
        once, with NULL cells."""
        g = F.col(geom)
        if self.extent is None:
            nothing = F.lit(None).cast("bigint")
            return df.withColumns({"cx": nothing, "cy": nothing})
        x0, y0, x1, y1 = self.extent
        margin = self.reach + self.size

        def span(axis: str, start: float, stop: float) -> Column:
            # greatest and least skip NULLs: without a geometry there must be no cells.
            low = F.greatest(g[axis + "min"], F.lit(start - margin))
            high = F.least(g[axis + "max"], F.lit(stop + margin))
            return F.when(g[axis + "min"].isNotNull(), _span(low, high, self.size))

        cols, rows = span("x", x0, x1), span("y", y0, y1)
        return df.withColumn("cx", F.explode_outer(cols)).withColumn("cy", F.explode_outer(rows))

    # -- tests on a joined row ----------------------------------------------

    def hit_point(self, x: Column, y: Column) -> Column:
        exact = geo.near(x, y, F.col("near"), self.reach) | geo.within(x, y, F.col("strip"))
        return F.coalesce(F.col("inside") | exact, F.lit(False))

    def hit_geometry(self, g: Column) -> Column:
        """Is the geometry within reach of the area, as far as this cell can tell?  True
        in at least one of the geometry's cells exactly when they are within reach."""
        near, strip, no = F.col("near"), F.col("strip"), F.lit(False)

        def anchored(known: Column | None = None) -> Column:
            """Has a part its first vertex in this cell and in the area?"""
            return F.exists(
                geo.anchors(g),
                lambda v: (F.floor(v["x"] / self.size) == F.col("cx"))
                & (F.floor(v["y"] / self.size) == F.col("cy"))
                & (F.coalesce(geo.within(v["x"], v["y"], strip), no) if known is None else known),
            )

        def meeting(segs: Column) -> Column:
            touching = F.exists(
                segs, lambda s: F.exists(near, lambda t: geo.segments_within(s, t, self.reach))
            )
            covered = F.exists(near, lambda t: geo.within(t["x1"], t["y1"], segs))
            return anchored() | touching | covered

        return (
            F.when(F.col("inside").isNull(), no)
            .when(geo.is_point(g), self.hit_point(g["xmin"], g["ymin"]))
            # Away from the boundary only a part that lies wholly inside can matter here.
            .when(F.col("inside"), anchored(F.lit(True)))
            .otherwise(geo.bind(geo.segments(g), meeting))
        )


def _pieces(cells: DataFrame) -> int:
    """Cells and the segments that they hold, each as often as it is held."""
    held = [F.coalesce(F.size(c), F.lit(0)) for c in ("near", "strip")]
    return cells.agg(F.sum(1 + F.greatest(held[0], F.lit(0)) + F.greatest(held[1], F.lit(0)))).first()[0] or 0


def build(areas: DataFrame, key: str, size: float, reach: float, broadcast_rows: int) -> AreaIndex:
    """Index ``areas`` (``key``, ``geom``).

    One row of totals is fetched: it bounds the number of cells and segments.  Where these
    are few, the index is stored and what would be sent is counted there, segments repeated by
    cell included; that decides whether it may be broadcast.
    """
    areas = areas.select(key, "geom").filter(F.col("geom").isNotNull())
    g = F.col("geom")
    width = F.floor((g["xmax"] - g["xmin"]) / size) + 2 + 2 * int(reach // size + 1)
    height = F.floor((g["ymax"] - g["ymin"]) / size) + 2 + 2 * int(reach // size + 1)
    totals = areas.agg(
        F.min(g["xmin"]), F.min(g["ymin"]), F.max(g["xmax"]), F.max(g["ymax"]),
        F.sum(width * height), F.sum(F.size(geo.segments(g))),
    ).first()
    extent = None if totals[0] is None else tuple(totals[:4])

    edges = areas.select(key, F.explode(geo.segments(g)).alias("s"))
    s = F.col("s")
    x_low, x_high = F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])
    y_low, y_high = F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"])
    grown = reach + _SLACK
    near = (
        edges.withColumn("cx", F.explode(_span(x_low - grown, x_high + grown, size)))
        .withColumn("cy", F.explode(_span(y_low - grown, y_high + grown, size)))
        .groupBy(key, "cx", "cy")
        .agg(F.collect_list("s").alias("near"))
    )
    strips = (
        edges.withColumn("cy", F.explode(_span(y_low, y_high, size)))
        .groupBy(key, "cy")
        .agg(F.collect_list("s").alias("strip"))
    )
    box = (
        areas.select(
            key,
            F.explode(_span(g["xmin"], g["xmax"], size)).alias("cx"),
            _span(g["ymin"], g["ymax"], size).alias("rows"),
        )
        .select(key, "cx", F.explode("rows").alias("cy"))
    )
    middle_x, middle_y = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size
    # Away from the boundary a cell is inside or outside as a whole: its middle tells.
    bounding = F.col("near").isNotNull()
    cells = (
        near.join(box, [key, "cx", "cy"], "full")
        .join(strips, [key, "cy"], "left")
        .withColumn("inside", ~bounding & F.coalesce(geo.within(middle_x, middle_y, F.col("strip")), F.lit(False)))
        .filter(bounding | F.col("inside"))
        .select(key, "cx", "cy", "inside", "near", F.when(bounding, F.col("strip")).alias("strip"))
    )
    if extent is None:
        cells = F.broadcast(cells)
    elif max(totals[4], totals[5]) <= broadcast_rows:
        cells = stored(cells)
        cells = F.broadcast(cells) if _pieces(cells) <= broadcast_rows else cells
    return AreaIndex(cells, size, reach, extent)
