"""Planar geometry as native column expressions.

All functions take and return columns of the geometry struct of ``model``; none
uses Python workers.  Points never touch the nested arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.model import PARTS_DDL

# Names of the geometry kinds.
POINT_KINDS = ("POINT", "MULTIPOINT")
LINE_KINDS = ("LINESTRING", "MULTILINESTRING")
POLYGON_KINDS = ("POLYGON", "MULTIPOLYGON")
KINDS = POINT_KINDS + LINE_KINDS + POLYGON_KINDS + ("GEOMETRYCOLLECTION",)


# -- constructors ----------------------------------------------------------

def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _geometry(kind: Column, xmin, ymin, xmax, ymax, parts: Column) -> Column:
    return F.struct(
        kind.alias("kind"),
        xmin.cast("double").alias("xmin"),
        ymin.cast("double").alias("ymin"),
        xmax.cast("double").alias("xmax"),
        ymax.cast("double").alias("ymax"),
        parts.cast(PARTS_DDL).alias("parts"),
    )


def point(x: Column, y: Column) -> Column:
    made = _geometry(F.lit("POINT"), x, y, x, y, F.lit(None))
    return F.when(x.isNotNull() & y.isNotNull(), made)


def part(kind: str, *rings: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.array(*rings).alias("rings"))


def ring(*xy: tuple[Column | float, Column | float]) -> Column:
    def col(v):
        return v if isinstance(v, Column) else F.lit(float(v))

    return F.array(*[_xy(col(x), col(y)) for x, y in xy])


def from_parts(kind: str | Column, parts: Column) -> Column:
    """Geometry of any kind; the bounding box is worked out from the vertices."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    vertices = _vertices(parts)
    xs = F.transform(vertices, lambda v: v["x"])
    ys = F.transform(vertices, lambda v: v["y"])
    return _geometry(
        kind, F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), parts
    )


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Axis-aligned rectangle, ``x1 <= x2`` and ``y1 <= y2``."""
    shell = ring((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))
    return _geometry(
        F.lit("POLYGON"), x1, y1, x2, y2, F.array(part("POLYGON", shell))
    )


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once however often ``fn`` uses it."""
    return F.transform(F.array(value), lambda v: fn(v))[0]


def evaluated(df: DataFrame, value: Column, *names: str) -> DataFrame:
    """``df`` with the fields of the struct ``value`` as columns, worked out at this very
    place: a generator keeps later filters from being pushed below it, which would
    repeat a costly expression inside the filter."""
    return df.select("*", F.inline(F.array(value)).alias(*names))


# -- structure -------------------------------------------------------------

def is_point(g: Column) -> Column:
    return g["kind"] == "POINT"


def _vertices(parts: Column) -> Column:
    return F.flatten(F.flatten(F.transform(parts, lambda p: p["rings"])))


def _segment(a: Column, b: Column, areal: Column) -> Column:
    return F.struct(
        a["x"].alias("x1"), a["y"].alias("y1"),
        b["x"].alias("x2"), b["y"].alias("y2"), areal.alias("areal"),
    )


def _along(r: Column, fn) -> Column:
    """Apply ``fn(previous, next)`` to the consecutive vertices of a ring."""
    n = F.size(r)
    pairs = F.zip_with(F.slice(r, F.lit(1), n - 1), F.slice(r, F.lit(2), n - 1), fn)
    return F.when(n > 1, pairs).otherwise(F.transform(r, lambda v: fn(v, v)))


def segments(g: Column) -> Column:
    """All segments; a point is a segment of length zero.  ``areal`` marks those
    that bound a surface."""
    own = F.struct(g["xmin"].alias("x"), g["ymin"].alias("y"))

    def of_part(p: Column) -> Column:
        areal = p["kind"] == "POLYGON"
        return F.flatten(
            F.transform(p["rings"], lambda r: _along(r, lambda a, b: _segment(a, b, areal)))
        )

    return F.when(is_point(g), F.array(_segment(own, own, F.lit(False)))).otherwise(
        F.flatten(F.transform(g["parts"], of_part))
    )


def anchors(g: Column) -> Column:
    """First vertex of every part."""
    own = F.struct(g["xmin"].alias("x"), g["ymin"].alias("y"))
    return F.when(is_point(g), F.array(own)).otherwise(
        F.transform(g["parts"], lambda p: p["rings"][0][0])
    )


def snap(g: Column, step: float) -> Column:
    """Every coordinate rounded to a multiple of ``step``."""

    def s(v: Column) -> Column:
        return F.rint(v / step) * step

    parts = F.transform(
        g["parts"],
        lambda p: F.struct(
            p["kind"].alias("kind"),
            F.transform(
                p["rings"], lambda r: F.transform(r, lambda v: _xy(s(v["x"]), s(v["y"])))
            ).alias("rings"),
        ),
    )
    made = _geometry(
        g["kind"], s(g["xmin"]), s(g["ymin"]), s(g["xmax"]), s(g["ymax"]),
        F.when(~is_point(g), parts),
    )
    return F.when(g.isNotNull(), made)


# -- measures --------------------------------------------------------------

def length(g: Column) -> Column:
    """Total length of all segments, in the unit of the coordinates."""
    return F.aggregate(
        segments(g),
        F.lit(0.0),
        lambda acc, s: acc + F.hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]),
    )


def _weighted(w: Column, wx: Column, wy: Column) -> Column:
    return F.struct(w.alias("w"), wx.alias("wx"), wy.alias("wy"))


def _total(items: Column) -> Column:
    zero = _weighted(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return F.aggregate(
        items,
        zero,
        lambda t, i: _weighted(t["w"] + i["w"], t["wx"] + i["wx"], t["wy"] + i["wy"]),
    )


def _ring_moment(r: Column, ox: Column, oy: Column) -> Column:
    """Signed area and first moments of a ring, relative to an origin near it:
    far from the origin the cross products would cancel away the digits."""

    def step(a: Column, b: Column) -> Column:
        ax, ay, bx, by = a["x"] - ox, a["y"] - oy, b["x"] - ox, b["y"] - oy
        cross = ax * by - bx * ay
        return _weighted(cross / 2.0, (ax + bx) * cross / 6.0, (ay + by) * cross / 6.0)

    return _total(_along(r, step))


def _surface_moments(g: Column) -> Column:
    ox, oy = g["xmin"], g["ymin"]

    def oriented(m: Column, index: Column) -> Column:
        sign = F.signum(m["w"]) * F.when(index == 0, 1.0).otherwise(-1.0)
        return _weighted(sign * m["w"], sign * m["wx"], sign * m["wy"])

    def of_part(p: Column) -> Column:
        moments = F.transform(p["rings"], lambda r: _ring_moment(r, ox, oy))
        return F.transform(moments, oriented)

    surfaces = F.filter(g["parts"], lambda p: p["kind"] == "POLYGON")
    return _total(F.flatten(F.transform(surfaces, of_part)))


def area(g: Column) -> Column:
    """Surface of the polygon parts, holes taken off."""
    return _surface_moments(g)["w"]


def centroid(g: Column) -> Column:
    """``struct<x, y>``: weighted by surface, else by length, else the mean of the
    vertices, whichever highest dimension has a size above zero."""
    ox, oy = g["xmin"], g["ymin"]

    def of_segment(s: Column) -> Column:
        w = F.hypot(s["x2"] - s["x1"], s["y2"] - s["y1"])
        return _weighted(
            w, w * ((s["x1"] + s["x2"]) / 2.0 - ox), w * ((s["y1"] + s["y2"]) / 2.0 - oy)
        )

    def of_vertex(v: Column) -> Column:
        return _weighted(F.lit(1.0), v["x"] - ox, v["y"] - oy)

    def mean(moments: Column) -> Column:
        return bind(
            moments,
            lambda m: F.when(
                m["w"] > 0,
                _xy(ox + F.try_divide(m["wx"], m["w"]), oy + F.try_divide(m["wy"], m["w"])),
            ),
        )

    has_surface = F.exists(g["parts"], lambda p: p["kind"] == "POLYGON")
    has_length = F.exists(g["parts"], lambda p: p["kind"] != "POINT")
    by_surface = F.when(has_surface, mean(_surface_moments(g)))
    by_length = F.when(has_length, mean(_total(F.transform(segments(g), of_segment))))
    by_vertex = mean(_total(F.transform(_vertices(g["parts"]), of_vertex)))
    return F.when(is_point(g), _xy(g["xmin"], g["ymin"])).otherwise(
        F.coalesce(by_surface, by_length, by_vertex)
    )


def snapped_centroid(g: Column, step: float) -> Column:
    """Centroid of the snapped geometry."""
    return F.when(
        is_point(g), _xy(F.rint(g["xmin"] / step) * step, F.rint(g["ymin"] / step) * step)
    ).otherwise(bind(snap(g, step), centroid))


# -- relations -------------------------------------------------------------

def point_segment_distance(x: Column, y: Column, s: Column) -> Column:
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    along = F.try_divide((x - s["x1"]) * dx + (y - s["y1"]) * dy, dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    return F.hypot(s["x1"] + t * dx - x, s["y1"] + t * dy - y)


def _side(s: Column, x: Column, y: Column) -> Column:
    return (s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"])


def segments_meet(s: Column, t: Column) -> Column:
    """Do two segments share a point?  Their boxes overlap and neither lies wholly on
    one side of the other; holds for collinear and zero-length ones too."""
    overlap = (
        (F.least(s["x1"], s["x2"]) <= F.greatest(t["x1"], t["x2"]))
        & (F.least(t["x1"], t["x2"]) <= F.greatest(s["x1"], s["x2"]))
        & (F.least(s["y1"], s["y2"]) <= F.greatest(t["y1"], t["y2"]))
        & (F.least(t["y1"], t["y2"]) <= F.greatest(s["y1"], s["y2"]))
    )
    return (
        overlap
        & (_side(s, t["x1"], t["y1"]) * _side(s, t["x2"], t["y2"]) <= 0)
        & (_side(t, s["x1"], s["y1"]) * _side(t, s["x2"], s["y2"]) <= 0)
    )


def segments_within(s: Column, t: Column, reach: float) -> Column:
    """Are two segments at most ``reach`` apart?  Apart segments are nearest at an end
    of one of them."""
    if reach == 0:
        return segments_meet(s, t)
    close = (
        (point_segment_distance(t["x1"], t["y1"], s) <= reach)
        | (point_segment_distance(t["x2"], t["y2"], s) <= reach)
        | (point_segment_distance(s["x1"], s["y1"], t) <= reach)
        | (point_segment_distance(s["x2"], s["y2"], t) <= reach)
    )
    return segments_meet(s, t) | close


def within(x: Column, y: Column, segs: Column) -> Column:
    """Even-odd test against the areal segments (the boundary itself is left to a
    distance test)."""
    crossings = F.aggregate(
        segs,
        F.lit(0),
        lambda n, s: n
        + F.when(
            s["areal"]
            & ((s["y1"] > y) != (s["y2"] > y))
            & (
                x
                < s["x1"]
                + (s["x2"] - s["x1"]) * F.try_divide(y - s["y1"], s["y2"] - s["y1"])
            ),
            1,
        ).otherwise(0),
    )
    return crossings % 2 == 1


def near(x: Column, y: Column, segs: Column, reach: Column | float) -> Column:
    """Is a segment at most ``reach`` away from the point?"""
    return F.exists(segs, lambda s: point_segment_distance(x, y, s) <= reach)


def box_gap(a: Column, b: Column) -> Column:
    """Distance between the two bounding boxes; never above the true distance."""
    zero = F.lit(0.0)
    dx = F.greatest(zero, a["xmin"] - b["xmax"], b["xmin"] - a["xmax"])
    dy = F.greatest(zero, a["ymin"] - b["ymax"], b["ymin"] - a["ymax"])
    return F.hypot(dx, dy)


def dwithin(a: Column, b: Column, reach: float) -> Column:
    """Are the two geometries at most ``reach`` apart (inclusive)?"""

    def exact(sa: Column, sb: Column) -> Column:
        touching = F.exists(sa, lambda s: F.exists(sb, lambda t: segments_within(s, t, reach)))
        b_in_a = F.exists(anchors(b), lambda v: within(v["x"], v["y"], sa))
        a_in_b = F.exists(anchors(a), lambda v: within(v["x"], v["y"], sb))
        return touching | b_in_a | a_in_b

    # Between two points the gap of the boxes is the distance itself.
    return (box_gap(a, b) <= reach) & F.when(is_point(a) & is_point(b), F.lit(True)).otherwise(
        bind(segments(a), lambda sa: bind(segments(b), lambda sb: exact(sa, sb)))
    )


def intersects(a: Column, b: Column) -> Column:
    return dwithin(a, b, 0.0)


# -- text ------------------------------------------------------------------

def _decimal(v: Column, digits: int) -> Column:
    fixed = F.format_string(f"%.{digits}f", F.round(v, digits) + F.lit(0.0))
    return F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit(".")) if digits else fixed


def geojson(g: Column, digits: int = 9) -> Column:
    """GeoJSON text with at most ``digits`` decimals."""

    def xy(v: Column) -> Column:
        return F.concat(
            F.lit("["), _decimal(v["x"], digits), F.lit(","), _decimal(v["y"], digits), F.lit("]")
        )

    def listed(items: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))

    def ring_text(r: Column) -> Column:
        return listed(F.transform(r, xy))

    def polygon_text(p: Column) -> Column:
        return listed(F.transform(p["rings"], ring_text))

    def first_ring(p: Column) -> Column:
        return ring_text(p["rings"][0])

    def first_vertex(p: Column) -> Column:
        return xy(p["rings"][0][0])

    parts = g["parts"]

    def typed(name: str, coordinates: Column) -> Column:
        return F.concat(
            F.lit('{"type":"' + name + '","coordinates":'), coordinates, F.lit("}")
        )

    def simple(p: Column) -> Column:
        return (
            F.when(p["kind"] == "POLYGON", typed("Polygon", polygon_text(p)))
            .when(p["kind"] == "LINESTRING", typed("LineString", first_ring(p)))
            .otherwise(typed("Point", first_vertex(p)))
        )

    own = F.struct(g["xmin"].alias("x"), g["ymin"].alias("y"))
    collection = F.concat(
        F.lit('{"type":"GeometryCollection","geometries":'),
        listed(F.transform(parts, simple)),
        F.lit("}"),
    )
    return (
        F.when(is_point(g), typed("Point", xy(own)))
        .when(g["kind"] == "MULTIPOINT", typed("MultiPoint", listed(F.transform(parts, first_vertex))))
        .when(
            g["kind"] == "MULTILINESTRING",
            typed("MultiLineString", listed(F.transform(parts, first_ring))),
        )
        .when(
            g["kind"] == "MULTIPOLYGON",
            typed("MultiPolygon", listed(F.transform(parts, polygon_text))),
        )
        .when(g["kind"] == "GEOMETRYCOLLECTION", collection)
        .when(g["kind"].isNotNull(), simple(parts[0]))
    )


def geojson_vertices(text: Column) -> Column:
    """``array<array<double>>`` of the [lon, lat] pairs of a Point, Polygon or
    MultiPolygon text; NULL for other types and for malformed text."""
    kind = F.get_json_object(text, "$.type")
    body = F.get_json_object(text, "$.coordinates")
    return (
        F.when(kind == "Polygon", F.flatten(F.from_json(body, "array<array<array<double>>>")))
        .when(
            kind == "MultiPolygon",
            F.flatten(F.flatten(F.from_json(body, "array<array<array<array<double>>>>"))),
        )
        .when(kind == "Point", F.array(F.from_json(body, "array<double>")))
    )


def _read_parts(kind: Column, body: Column) -> Column:
    """Parts of the coordinates ``body`` (JSON text) of one geometry but a collection."""

    def nested(depth: int) -> Column:
        return F.from_json(body, "array<" * depth + "double" + ">" * depth)

    def vertex(v: Column) -> Column:
        return _xy(F.get(v, F.lit(0)), F.get(v, F.lit(1)))

    def line(vertices: Column) -> Column:
        return F.transform(vertices, vertex)

    def made(name: str, rings: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), rings.alias("rings"))

    def alone(v: Column) -> Column:
        return made("POINT", F.array(F.array(vertex(v))))

    return (
        F.when(kind == "Point", F.array(alone(nested(1))))
        .when(kind == "MultiPoint", F.transform(nested(2), alone))
        .when(kind == "LineString", F.array(made("LINESTRING", F.array(line(nested(2))))))
        .when(
            kind == "MultiLineString",
            F.transform(nested(3), lambda r: made("LINESTRING", F.array(line(r)))),
        )
        .when(kind == "Polygon", F.array(made("POLYGON", F.transform(nested(3), line))))
        .when(
            kind == "MultiPolygon",
            F.transform(nested(4), lambda p: made("POLYGON", F.transform(p, line))),
        )
    )


def _sound(parts: Column) -> Column:
    """Has every part rings, and every ring enough vertices with both coordinates?"""

    def ring_sound(least: Column):
        return lambda r: (F.size(r) >= least) & F.forall(
            r, lambda v: v["x"].isNotNull() & v["y"].isNotNull()
        )

    def part_sound(p: Column) -> Column:
        least = F.when(p["kind"] == "POLYGON", 4).when(p["kind"] == "LINESTRING", 2).otherwise(1)
        return (F.size(p["rings"]) > 0) & F.forall(p["rings"], ring_sound(least))

    return (F.size(parts) > 0) & F.forall(parts, part_sound)


def from_geojson(text: Column) -> Column:
    """The geometry of a GeoJSON text of any of the seven kinds; further coordinates than two
    are passed over.  NULL for NULL, for malformed and for empty ones, and for a collection
    inside a collection."""
    kind = F.get_json_object(text, "$.type")
    members = F.from_json(
        F.get_json_object(text, "$.geometries"), "array<struct<type:string,coordinates:string>>"
    )
    parts = F.when(
        kind == "GeometryCollection",
        F.flatten(F.transform(members, lambda m: _read_parts(m["type"], m["coordinates"]))),
    ).otherwise(_read_parts(kind, F.get_json_object(text, "$.coordinates")))

    def made(p: Column) -> Column:
        first = p[0]["rings"][0][0]
        return F.when(
            _sound(p),
            F.when(kind == "Point", point(first["x"], first["y"])).otherwise(from_parts(F.upper(kind), p)),
        )

    return bind(parts, made)
