"""Likely duplicates inside a report and across lots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.functions import geometry as geo
from lotscope.functions.projection import LAMBERT93
from lotscope.functions.sizing import at_most
from lotscope.functions.storing import stored
from lotscope.functions.text import day_text
from lotscope.operators.marts import described_source
from lotscope.workspace import Workspace

# What two records of a report must share, besides place and kind of geometry.
SHARED = (
    "cd_nom", "observers", "id_nomenclature_sex", "id_nomenclature_obs_technique",
    "count_max", "count_min", "id_nomenclature_life_stage", "date_min",
)


def within_report(ws: Workspace) -> DataFrame:
    """Groups of records of one report that agree on everything in ``SHARED``, on the
    kind of geometry and on the place (the centroid of the snapped geometry).

    Records are counted per lot, before the reports that cover the lot multiply them.
    Copies are combined before the shuffle, so a large group of them travels as one row
    per task.  Grouping is on local coordinates; only the groups that survive are projected
    and named.
    """
    x, y = F.col("x"), F.col("y")
    same = [*SHARED, "geom_type", "x", "y"]
    rows = ws.reported(ws.observation).select(
        "lot_id", *SHARED, F.col("geom.kind").alias("geom_type"), "geom"
    )
    by_lot = (
        geo.evaluated(rows, geo.snapped_centroid(F.col("geom"), ws.params.snap_m), "x", "y")
        .groupBy("lot_id", *same)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    groups = (
        ws.per_report(by_lot)
        .groupBy("report_id", *same)
        .agg(F.sum("n").alias("nb_data_similaire"))
        .filter("nb_data_similaire > 1")
    )
    taxa = ws.tables.taxref.select("cd_nom", "lb_nom", "nom_vern")
    return (
        groups.join(taxa, "cd_nom", "left")
        .select(
            "report_id", "cd_nom", "lb_nom", "nom_vern", "geom_type",
            LAMBERT93.lat(x, y).alias("lat"),
            LAMBERT93.lon(x, y).alias("lon"),
            "observers", "id_nomenclature_sex", "id_nomenclature_obs_technique",
            "count_max", "count_min", "id_nomenclature_life_stage",
            day_text(F.col("date_min")).alias("date"),
            "nb_data_similaire",
        )
        .orderBy("report_id", F.desc("nb_data_similaire"))
    )


# -- across lots -----------------------------------------------------------
#
# Geometries meet in grid cells.  Cells come in levels, each 4 times coarser than the
# one before; a geometry's own level is the first whose cell is as large as it is, so
# it covers at most a few cells there however large it may be, and those are not much
# larger than itself.  A pair is looked for at the coarser of its two levels and counted
# in one cell only: the one holding the lower left corner of the overlap of the boxes.

_LEVEL_FACTOR = 4.0


def _finest(ws: Workspace) -> float:
    """Side of the finest cells: the distance, or a metre where only one place is meant."""
    return ws.params.duplicate_distance_m or 1.0


def _level(g: Column, reach: float) -> Column:
    extent = F.greatest(g["xmax"] - g["xmin"], g["ymax"] - g["ymin"])
    return (
        F.when(extent <= reach, 0)
        .otherwise(F.ceil(F.log(extent / reach) / math.log(_LEVEL_FACTOR)).cast("int"))
    )


def _cell_size(level: Column, reach: float) -> Column:
    return F.lit(reach) * F.pow(F.lit(_LEVEL_FACTOR), level)


def _in_cells(df: DataFrame, meetings: Column, margin: float, reach: float) -> DataFrame:
    """One row per meeting (``leads``, ``level``) and cell of that level under the box
    grown by ``margin``."""
    box, size = F.col("geom"), _cell_size(F.col("level"), reach)

    def span(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor((low - margin) / size), F.floor((high + margin) / size)))

    return (
        df.select("*", F.inline(meetings))
        .withColumn("cx", span(box["xmin"], box["xmax"]))
        .withColumn("cy", span(box["ymin"], box["ymax"]))
        .drop("own", "levels")
    )


def _meetings(first: bool) -> Column:
    """Where a geometry of the first or of the second side goes: to cells of its own
    level, where it leads, and to the coarser levels present, where one of the other
    side leads.  Of two geometries of one level the first side's leads."""
    own, bits = F.col("own"), F.col("levels")
    lowest = own + 1 if first else own
    highest = F.length(F.bin(bits)) - 1
    led = F.when(
        lowest <= highest,
        F.filter(F.sequence(lowest, highest), lambda level: F.getbit(bits, level) == 1),
    ).otherwise(F.array().cast("array<int>"))
    leading = F.array(own) if first else F.when(own > 0, F.array(own)).otherwise(
        F.array().cast("array<int>")
    )

    def tagged(levels: Column, leader: str) -> Column:
        return F.transform(
            levels, lambda level: F.struct(F.lit(leader).alias("leads"), level.alias("level"))
        )

    return F.concat(
        tagged(leading, "first" if first else "second"),
        tagged(led, "second" if first else "first"),
    )


def _hashes(*columns: Column | str) -> list[Column]:
    """Two independent hashes: 128 bits that stand for what they are taken of."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def _anchor(g: Column) -> tuple[Column, Column]:
    """A point of the geometry: the point itself, else the first vertex of its first ring."""
    first = F.get(F.get(F.get(g["parts"], 0)["rings"], 0), 0)
    return tuple(F.when(geo.is_point(g), g[f"{c}min"]).otherwise(first[c]) for c in "xy")


def placed(ws: Workspace) -> DataFrame:
    """Records (``n``) of every lot at every place that may pair, with the hashes of the place
    (``p1``, ``p2``) and of the spot it lies in (``s1``, ``s2``).  Counted once and stored.

    A place is a taxon, a start and a distinct geometry, however many records share it.  Places of
    a taxon and start whose anchor, a point of the geometry, lies within one small square form a
    spot: they are all within the distance of one another.  A place without one is a spot of its own.

    A taxon and start found in a single lot, or in no reported one, cannot pair and is
    dropped; ``levels`` are the grid levels present for the taxon and start, as bits.  That is
    decided first, from narrow columns.  The year is a join key only so that the join shuffles
    both sides: joined on its grouping keys alone, the aggregate would be taken where it lies,
    and adaptive execution splits a hot key only between two shuffled sides.
    """
    reach, cell = ws.params.duplicate_distance_m, _finest(ws)
    key = ["cd_nom", "date_min"]
    g = F.col("geom")
    found = (
        ws.observation.select("lot_id", *key, "id_source", "id_import", "geom")
        .filter(F.col("geom.kind").isNotNull())
        .filter(F.col("cd_nom").isNotNull() & F.col("date_min").isNotNull())
        .withColumn("year", F.year("date_min"))
    )
    level = _level(g, cell)
    several = (
        found.join(ws.reported_lots.withColumn("reported", F.lit(True)), "lot_id", "left")
        .groupBy(*key, "year")
        .agg(
            F.min("lot_id").alias("lot0"), F.max("lot_id").alias("lot1"),
            F.max("reported").alias("reported"),
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), level)).alias("levels"),
        )
        .filter("reported AND lot0 <> lot1")
        .select(*key, "year", "levels")
    )
    # Somewhat below the side of the square whose diagonal is the distance.
    side = F.lit(reach * 0.7)
    x, y = _anchor(g)
    shared = F.struct(F.floor(x / side), F.floor(y / side))
    place, square = _hashes(*key, "geom"), _hashes(*key, shared)
    spot = [F.when(x.isNotNull() & y.isNotNull(), s).otherwise(p) if reach else p for s, p in zip(square, place)]
    hashed = found.join(several, [*key, "year"]).withColumns(dict(zip(("p1", "p2", "s1", "s2"), [*place, *spot])))
    return stored(
        hashed.groupBy("p1", "p2", "s1", "s2", *key, "levels", "lot_id", "id_source", "id_import")
        .agg(F.count(F.lit(1)).alias("n"), F.first("geom").alias("geom"))
    )


def places(ws: Workspace, found: DataFrame) -> DataFrame:
    """One row per place: its hashes, taxon, start, ``geom``, and whether a ``reported`` lot is
    there.  What lots hold of a place stays another relation."""
    flagged = found.join(ws.reported_lots.distinct().withColumn("reported", F.lit(True)), "lot_id", "left")
    return stored(
        flagged.groupBy("p1", "p2", "s1", "s2", "cd_nom", "date_min", "levels")
        .agg(F.first("geom").alias("geom"), F.max("reported").alias("reported"))
    )


_MEETING = ["cd_nom", "date_min", "leads", "level", "cx", "cy"]
#: Tests of pairs that one task is given of a meeting place.
_TESTS = 1_000_000


def _spread(spots: DataFrame, first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides with a column ``share``: where many of the ``spots`` meet, the first side is
    dealt out by its hash and the second repeated, so that no task is given all pairs of a hot
    cell.  Cells are only counted when some taxon and start has spots enough for a hot one."""
    reported = F.count(F.when(F.col("n_reported") > 0, 1))
    many = spots.groupBy("cd_nom", "date_min").agg((F.count(F.lit(1)) * reported).alias("tests"))
    if at_most(many.filter(F.col("tests") > _TESTS), 0):
        return first.withColumn("share", F.lit(0)), second.withColumn("share", F.lit(0))

    def counted(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*_MEETING).agg(F.count(F.lit(1)).alias(name))

    heavy = counted(first, "n_first").join(counted(second, "n_second"), _MEETING).select(
        *_MEETING, _shares(F.col("n_first"), F.col("n_second")).alias("shares")
    ).filter("shares > 1")
    shares = F.coalesce("shares", F.lit(1))
    return (
        first.join(heavy, _MEETING, "left").withColumn("share", F.pmod("a_s1", shares)).drop("shares"),
        second.join(heavy, _MEETING, "left").withColumn("share", _each(shares)).drop("shares"),
    )


def _shares(first: Column, second: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(first * second / _TESTS)).cast("bigint")


def _each(shares: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1))


def close_spots(ws: Workspace, every: DataFrame) -> DataFrame:
    """Pairs of different spots of ``every`` place whose boxes are at most the distance apart, the
    first with a reported lot, and the number of ``shares`` that their places are compared in.
    They meet by their boxes alone; no vertices travel to the cells."""
    reach, cell = ws.params.duplicate_distance_m, _finest(ws)
    box, g = ("xmin", "ymin", "xmax", "ymax"), F.col("geom")
    ends = [(F.min if c.endswith("min") else F.max)(g[c]).alias(c) for c in box]
    spots = every.groupBy("s1", "s2", "cd_nom", "date_min", "levels").agg(
        *ends, F.count(F.lit(1)).alias("n"), F.count("reported").alias("n_reported")
    ).withColumn("geom", F.struct(*box)).drop(*box)
    spots = stored(spots.withColumn("own", _level(F.col("geom"), cell)))

    def side(df: DataFrame, prefix: str, first: bool) -> DataFrame:
        cells = _in_cells(df, _meetings(first), reach if first else 0.0, cell)
        return cells.select(*_MEETING, *(F.col(c).alias(prefix + c) for c in ("s1", "s2", "geom", "n", "n_reported")))

    ga, gb = F.col("a_geom"), F.col("b_geom")
    size = _cell_size(F.col("level"), cell)
    corner_x = F.floor(F.greatest(ga["xmin"] - reach, gb["xmin"]) / size)
    corner_y = F.floor(F.greatest(ga["ymin"] - reach, gb["ymin"]) / size)
    apart = (F.col("a_s1") != F.col("b_s1")) | (F.col("a_s2") != F.col("b_s2"))
    first, second = _spread(spots, side(spots.filter("n_reported > 0"), "a_", True), side(spots, "b_", False))
    return (
        first.join(second, [*_MEETING, "share"])
        .filter((F.col("cx") == corner_x) & (F.col("cy") == corner_y) & apart & (geo.box_gap(ga, gb) <= reach))
        .select("a_s1", "a_s2", "b_s1", "b_s2", _shares(F.col("a_n_reported"), F.col("b_n")).alias("shares"))
    )


def close_places(ws: Workspace, every: DataFrame) -> DataFrame:
    """Pairs of ``every`` place with places of different spots, of the same taxon and start and at most the distance
    apart, the first with a reported lot: ``a1``, ``a2``, ``b1``, ``b2``.  There is one test of the
    geometries per pair of *places* of close spots, never per pair of records or lots; places of
    one spot need none."""
    spots = stored(close_spots(ws, every))

    def of(prefix: str, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("s1", "s2", "p1", "p2", "geom")))

    pair = ["a_s1", "a_s2", "b_s1", "b_s2", "share"]
    first = spots.join(of("a", every.filter("reported")), pair[:2]).withColumn("share", F.pmod("a_p1", "shares"))
    second = spots.withColumn("share", _each(F.col("shares"))).join(of("b", every), pair[2:4])
    return (
        first.drop("shares").join(second.drop("shares"), pair)
        .filter(geo.dwithin(F.col("a_geom"), F.col("b_geom"), ws.params.duplicate_distance_m))
        .select(*(F.col(f"{x}_p{i}").alias(f"{x}{i}") for x in "ab" for i in (1, 2)))
    )


def _partners(ws: Workspace, near: DataFrame, held: DataFrame, *at: str) -> DataFrame:
    """The rows of ``held`` for each report with records of *other* lots of it ``near``, and
    their number as ``partners``.  ``near`` has the records ``n`` of a lot near each ``at``.

    The records of a report are added up once; what the lot itself holds of them is taken
    off, so lots are not paired with lots.
    """
    of_reports = ws.per_report(near).select("report_id", "lot_id", *at, F.col("n").alias("own"))
    totals = of_reports.groupBy("report_id", *at).agg(F.sum("own").alias("total"))
    left = F.col("total") - F.coalesce("own", F.lit(0))
    return (
        totals.join(held, [*at]).join(of_reports, ["report_id", "lot_id", *at], "left")
        .withColumn("partners", left).filter("partners > 0").drop("total", "own")
    )


def partners(ws: Workspace) -> DataFrame:
    """By report, source and import: the ``records`` that have records of *other* lots of the
    report within the distance, and the number of such ``pairs``.

    Within a spot, records are only counted by lot.  Between spots they are counted for each
    place of a close pair; a record with partners of both kinds is counted once.
    """
    found = placed(ws)
    held = found.drop("cd_nom", "date_min", "levels", "geom")
    lot = ["lot_id", "id_source", "id_import"]
    spots = held.groupBy("s1", "s2", *lot).agg(F.sum("n").alias("n"))
    by_lot = spots.groupBy("s1", "s2", "lot_id").agg(F.sum("n").alias("n"))
    within = _partners(ws, by_lot, spots, "s1", "s2")
    pairs = close_places(ws, places(ws, found))
    near = (
        pairs.join(held.select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), "lot_id", "n"), ["a1", "a2"])
        .groupBy(F.col("b1").alias("p1"), F.col("b2").alias("p2"), "lot_id").agg(F.sum("n").alias("n"))
    )
    between = _partners(ws, near, held, "p1", "p2").join(
        within.select("report_id", "s1", "s2", "lot_id", F.lit(True).alias("counted")),
        ["report_id", "s1", "s2", "lot_id"], "left",
    )
    both = within.withColumn("records", F.col("n")).unionByName(
        between.withColumn("records", F.when(F.col("counted"), 0).otherwise(F.col("n"))), allowMissingColumns=True
    )
    return both.groupBy("report_id", "id_source", "id_import").agg(
        F.sum("records").alias("records"), F.sum(F.col("n") * F.col("partners")).alias("pairs")
    )


def across_lots(ws: Workspace) -> DataFrame:
    """Other lots holding the same taxon at the same start and place: by source, the
    distinct records there and the number of pairs, for more than one pair.

    The other side is the whole base, so another lot of the same report counts too.
    """
    by_lot = partners(ws)
    imports = ws.tables.import_.select("id_import", F.col("additional_data").alias("import_data"))
    return (
        by_lot.join(ws.tables.source.select("id_source", "desc_source"), "id_source")
        .join(imports, "id_import", "left")
        .groupBy(
            "report_id", described_source(ws.params, "import_data", "desc_source").alias("nom_source")
        )
        .agg(
            F.sum("records").alias("nombre_donnees_dupliquees"), F.sum("pairs").alias("nb_paires")
        )
        .filter("nb_paires > 1")
        .orderBy("report_id", F.desc("nb_paires"))
    )


def alert_counts(ws: Workspace) -> DataFrame:
    """Groups inside the report and sources across lots."""
    inside = within_report(ws).groupBy("report_id").agg(F.count(F.lit(1)).alias("nb_doublon"))
    outside = across_lots(ws).groupBy("report_id").agg(F.count(F.lit(1)).alias("nb_source_doublon"))
    return ws.every_report(
        inside.join(outside, "report_id", "full"), nb_doublon=0, nb_source_doublon=0
    )
