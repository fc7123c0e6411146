from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

import shapes
from lotscope.functions import geometry as geo
from lotscope.functions.projection import LAMBERT93
from lotscope.model import GEOMETRY_DDL

HOLED = shapes.polygon(
    [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (2, 6), (6, 6), (6, 2), (2, 2)]
)
CONCAVE = shapes.polygon([(0, 0), (10, 0), (10, 10), (5, 2), (0, 10), (0, 0)])
CLOCKWISE = shapes.polygon([(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)])
TWO = shapes.geom(
    "MULTIPOLYGON",
    ("POLYGON", [[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]]),
    ("POLYGON", [[(10, 0), (14, 0), (14, 4), (10, 4), (10, 0)]]),
)
MIXED = shapes.geom(
    "GEOMETRYCOLLECTION",
    ("POINT", [[(100, 100)]]),
    ("LINESTRING", [[(50, 50), (60, 50)]]),
    ("POLYGON", [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]),
)
FLAT = shapes.polygon([(0, 0), (10, 0), (0, 0)])


def frame(spark, geoms):
    return spark.createDataFrame(list(enumerate(geoms)), f"i int, g {GEOMETRY_DDL}")


def values(spark, geoms, fn):
    rows = frame(spark, geoms).select("i", fn(F.col("g")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_area_and_length(spark):
    assert values(spark, [HOLED, CONCAVE, CLOCKWISE, TWO], geo.area) == [84.0, 60.0, 100.0, 20.0]
    assert values(spark, [shapes.line((0, 0), (3, 4), (3, 10))], geo.length) == [11.0]


def test_area_far_from_the_origin_keeps_its_digits(spark):
    x, y = 700000.4, 6400000.3
    (v,) = values(spark, [shapes.box(x, y, x + 0.5, y + 0.5)], geo.area)
    assert v == pytest.approx(0.25, abs=1e-8)


@pytest.mark.parametrize(
    "g, xy",
    [
        (shapes.point(3, 4), (3, 4)),
        (shapes.line((0, 0), (10, 0), (10, 10)), (7.5, 2.5)),
        (CLOCKWISE, (5, 5)),
        (HOLED, ((100 * 5 - 16 * 4) / 84, (100 * 5 - 16 * 4) / 84)),
        (TWO, ((4 * 1 + 16 * 12) / 20, (4 * 1 + 16 * 2) / 20)),
        (MIXED, (2, 2)),
        (FLAT, (5, 0)),
        (shapes.geom("MULTIPOINT", ("POINT", [[(0, 0)]]), ("POINT", [[(4, 8)]])), (2, 4)),
        (shapes.line((7, 7), (7, 7)), (7, 7)),
    ],
)
def test_centroid(spark, g, xy):
    (c,) = values(spark, [g], geo.centroid)
    assert (c["x"], c["y"]) == pytest.approx(xy)


def test_missing_geometry_gives_null(spark):
    nothing = (None, None, None, None, None, None)
    for fn in (geo.centroid, geo.area, geo.length, geo.geojson, lambda g: geo.snapped_centroid(g, 1e-6)):
        for v in values(spark, [None, nothing], fn):
            assert v is None or v["x"] is None


def test_snapped_centroid_ignores_noise_below_the_step(spark):
    a, b = values(
        spark,
        [shapes.point(1.0000001, 2), shapes.point(1.0000002, 2)],
        lambda g: geo.snapped_centroid(g, 1e-6),
    )
    assert a == b
    c, d = values(
        spark,
        [shapes.box(0, 0, 1, 1), shapes.box(0, 0, 1.0000003, 1)],
        lambda g: geo.snapped_centroid(g, 1e-6),
    )
    assert c == d


def random_shape(rng: random.Random, reach: float):
    x, y = rng.uniform(0, reach), rng.uniform(0, reach)
    size = rng.choice([0.5, 3, 20])
    kind = rng.randrange(5)
    if kind == 0:
        return shapes.point(x, y)
    if kind == 1:
        return shapes.line(*[(x + rng.uniform(0, size), y + rng.uniform(0, size)) for _ in range(3)])
    if kind == 2:
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(6))
        ring = [
            (x + size * rng.uniform(0.3, 1) * math.cos(a), y + size * rng.uniform(0.3, 1) * math.sin(a))
            for a in angles
        ]
        return shapes.polygon(ring + ring[:1])
    if kind == 3:
        hole = [(x + size * f, y + size * h) for f, h in ((0.2, 0.2), (0.2, 0.8), (0.8, 0.8), (0.8, 0.2), (0.2, 0.2))]
        outer = [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]
        return shapes.polygon(outer, hole)
    return shapes.geom(
        "GEOMETRYCOLLECTION",
        ("POINT", [[(x, y)]]),
        ("LINESTRING", [[(x + 1, y), (x + 1 + size, y + size)]]),
    )


def test_dwithin_and_intersects_agree_with_brute_force(spark):
    rng = random.Random(7)
    pairs = [(random_shape(rng, 25), random_shape(rng, 25)) for _ in range(600)]
    df = spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, a {GEOMETRY_DDL}, b {GEOMETRY_DDL}"
    )
    rows = df.select(
        "i",
        geo.dwithin(F.col("a"), F.col("b"), 2.0).alias("near"),
        geo.intersects(F.col("a"), F.col("b")).alias("meet"),
    ).collect()
    apart = [shapes.distance(a, b) for a, b in pairs]
    assert sum(d == 0 for d in apart) > 30 and sum(0 < d <= 2 for d in apart) > 15
    for r in rows:
        assert r["near"] == (apart[r["i"]] <= 2.0)
        assert r["meet"] == (apart[r["i"]] == 0)


def test_touching_counts_as_meeting(spark):
    square = shapes.box(0, 0, 10, 10)
    touching = [
        shapes.point(10, 5), shapes.point(0, 0), shapes.line((10, 2), (20, 2)),
        shapes.line((10, -5), (10, 3)), shapes.box(10, 10, 12, 12), shapes.box(2, 2, 3, 3),
    ]
    apart = [shapes.point(10.001, 5), shapes.line((11, 0), (11, 10)), shapes.box(-3, -3, -1, -1)]
    df = spark.createDataFrame(
        [(square, g) for g in touching + apart], f"a {GEOMETRY_DDL}, b {GEOMETRY_DDL}"
    )
    got = [r[0] for r in df.select(geo.intersects(F.col("a"), F.col("b"))).collect()]
    assert got == [True] * len(touching) + [False] * len(apart)


def test_inside_a_hole_is_outside(spark):
    df = spark.createDataFrame(
        [(HOLED, shapes.point(4, 4)), (HOLED, shapes.point(1, 1)), (HOLED, shapes.box(3, 3, 5, 5))],
        f"a {GEOMETRY_DDL}, b {GEOMETRY_DDL}",
    )
    got = [r[0] for r in df.select(geo.intersects(F.col("a"), F.col("b"))).collect()]
    assert got == [False, True, False]


def test_geojson(spark):
    got = values(
        spark,
        [
            shapes.point(4.5, 45.1234567891),
            shapes.line((0, 0), (1.5, -2)),
            TWO,
            HOLED,
            shapes.geom("MULTIPOINT", ("POINT", [[(0, 0)]]), ("POINT", [[(100, -0.00000000001)]])),
            MIXED,
        ],
        geo.geojson,
    )
    assert got[0] == '{"type":"Point","coordinates":[4.5,45.123456789]}'
    assert got[1] == '{"type":"LineString","coordinates":[[0,0],[1.5,-2]]}'
    assert got[2].startswith('{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],')
    assert got[3].endswith("[[[0,0],[10,0],[10,10],[0,10],[0,0]],[[2,2],[2,6],[6,6],[6,2],[2,2]]]}")
    assert got[4] == '{"type":"MultiPoint","coordinates":[[0,0],[100,0]]}'
    assert got[5].startswith('{"type":"GeometryCollection","geometries":[{"type":"Point",')


def test_geojson_vertices_skips_malformed(spark):
    texts = [
        '{"type":"Polygon","coordinates":[[[1,2],[3,4],[1,2]]]}',
        '{"type":"MultiPolygon","coordinates":[[[[1,2],[3,4]]],[[[5,6]]]]}',
        '{"type":"Point","coordinates":[7,8]}',
        "{not json", None, '{"type":"LineString","coordinates":[[1,2]]}',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(geo.geojson_vertices(F.col("t"))).collect()]
    assert got == [
        [[1, 2], [3, 4], [1, 2]], [[1, 2], [3, 4], [5, 6]], [[7, 8]], None, None, None,
    ]


def test_projection_round_trip(spark):
    """Forward projection in plain Python, inverse in Spark."""
    p = LAMBERT93

    def forward(lon, lat):
        phi = math.radians(lat)
        iso = math.atanh(math.sin(phi)) - p.e * math.atanh(p.e * math.sin(phi))
        r, gamma = p.c * math.exp(-p.n * iso), p.n * math.radians(lon - p.lon0)
        return p.xs + r * math.sin(gamma), p.ys - r * math.cos(gamma)

    degrees = [(lon, lat) for lon in (-4.7, 3.0, 4.83, 8.2) for lat in (41.3, 45.76, 51.1)]
    df = spark.createDataFrame([(*d, *forward(*d)) for d in degrees], "lon double, lat double, x double, y double")
    rows = df.select(
        (p.lon(F.col("x"), F.col("y")) - F.col("lon")).alias("dlon"),
        (p.lat(F.col("x"), F.col("y")) - F.col("lat")).alias("dlat"),
    ).collect()
    assert all(abs(r["dlon"]) < 1e-9 and abs(r["dlat"]) < 1e-9 for r in rows)


ALL_KINDS = [
    shapes.point(1.5, -2.25),
    shapes.geom("MULTIPOINT", ("POINT", [[(0, 0)]]), ("POINT", [[(3, 4)]])),
    shapes.line((0, 0), (3, 4), (3, 9)),
    shapes.geom("MULTILINESTRING", ("LINESTRING", [[(0, 0), (1, 1)]]), ("LINESTRING", [[(5, 5), (9, 5)]])),
    shapes.polygon([(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]),
    shapes.geom(
        "MULTIPOLYGON",
        ("POLYGON", [[(0, 0), (1, 0), (1, 1), (0, 0)]]),
        ("POLYGON", [[(5, 5), (6, 5), (6, 6), (5, 5)]]),
    ),
    shapes.geom(
        "GEOMETRYCOLLECTION",
        ("POINT", [[(7, 7)]]), ("LINESTRING", [[(0, 0), (1, 2)]]),
        ("POLYGON", [[(0, 0), (2, 0), (2, 2), (0, 0)]]),
    ),
]


def test_geojson_is_read_back(spark):
    rows = [(i, g) for i, g in enumerate(ALL_KINDS)]
    df = spark.createDataFrame(rows, f"i int, g {GEOMETRY_DDL}")
    read = df.select("i", "g", geo.from_geojson(geo.geojson(F.col("g"))).alias("back"))
    assert read.filter("g <=> back").count() == len(ALL_KINDS)


def test_geojson_that_is_no_geometry_gives_null(spark):
    texts = [
        None, "", "{", "[]", '{"type":"Circle","coordinates":[1,2]}', '{"type":"Point"}',
        '{"type":"Point","coordinates":[]}', '{"type":"Point","coordinates":[1]}',
        '{"type":"Point","coordinates":["a",2]}', '{"type":"LineString","coordinates":[[1,2]]}',
        '{"type":"Polygon","coordinates":[]}', '{"type":"Polygon","coordinates":[[[0,0],[1,1],[0,0]]]}',
        '{"type":"MultiPoint","coordinates":[[1,2],null]}', '{"type":"GeometryCollection","geometries":[]}',
        '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1]}]}',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(geo.from_geojson(F.col("t")).isNotNull()).collect() == []


def test_geojson_with_heights(spark):
    df = spark.createDataFrame([('{"type":"Point","coordinates":[1,2,300]}',)], "t string")
    assert df.select(geo.geojson(geo.from_geojson(F.col("t")))).first()[0] == '{"type":"Point","coordinates":[1,2]}'


def test_geojson_without_decimals_keeps_its_zeros(spark):
    got = spark.range(1).select(geo._decimal(F.lit(100.2), 0), geo._decimal(F.lit(-0.2), 0), geo._decimal(F.lit(10.50), 3), geo._decimal(F.lit(20.0), 2)).first()
    assert tuple(got) == ("100", "0", "10.5", "20")
