"""Edge cases of each operator on small hand-made tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import shapes
from lotscope.functions import geometry, sizing, text
from lotscope.model import GEOMETRY_DDL
from lotscope.operators import (
    area_index, duplicates, invasive, kpi, layers, marts, metadata, reports, spatial, taxonomy,
    temporal, validation,
)


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def column(df, expression):
    return [r["r"] for r in df.select("i", expression.alias("r")).orderBy("i").collect()]


# -- text ------------------------------------------------------------------

def test_lot_id_keeps_a_missing_import(spark):
    df = spark.createDataFrame([(12, None), (12, 7), (None, 7)], "s int, m int")
    assert [r[0] for r in df.select(text.lot_id(F.col("s"), F.col("m"))).collect()] == ["12_", "12_7", "_7"]


def test_parse_lots(spark):
    df = one_column(spark, ["'7_1', '7_2'", '"a",, b ', "", None])
    assert column(df, text.parse_lots(F.col("v"))) == [["7_1", "7_2"], ["a", "b"], [], None]


def test_safe_file_name(spark):
    df = one_column(spark, ["Été à l'Œuvre n°3", "???", "", "Déjà_vu 2", "ligne\nsuite"])
    assert column(df, text.safe_file_name(F.col("v"))) == [
        "Ete_a_lOEuvre_n3", "rapport_sans_nom", "rapport_sans_nom", "Deja_vu_2", "lignesuite",
    ]


def test_report_names(spark):
    df = one_column(spark, ["Lot [A]/B été", None])
    assert column(df, text.report_file_name(F.col("v"))) == ["lot_a_b_été", None]
    assert column(df, text.report_address(text.report_file_name(F.col("v")), "u/")) == [
        "u/lot_a_b_ete.html", "u/.html",
    ]


def test_numbers(spark):
    df = one_column(spark, [1234567.5, 2.5, None, float("nan"), -1234.0], "double")
    s = "\u00a0"
    assert column(df, text.grouped_number(F.col("v"))) == [
        f"1{s}234{s}568", "2", "0", "nan", f"-1{s}234",
    ]
    assert column(df, text.grouped_number(F.col("v"), 1))[0] == f"1{s}234{s}567.5"
    shares = one_column(spark, [0.12345, 12.0, None, float("nan")], "double")
    assert column(shares, text.percent(F.col("v"))) == [f"12.3{s}%", f"1200.0{s}%", "-", f"nan{s}%"]


def test_json_flags(spark):
    df = one_column(spark, ['{"a": true}', '{"a": "false"}', '{"a": "maybe"}', "{}", None])
    assert column(df, text.json_flag(F.col("v"), "a")) == [True, False, None, None, None]


def test_blank_padded_codes(spark):
    df = one_column(spark, ["ES", "ES  ", "SSES", None])
    assert column(df, text.same_code(F.col("v"), "ES")) == [True, True, False, None]


def test_broadcast_only_when_small(spark):
    df = spark.range(10)
    assert sizing.at_most(df, 10) and not sizing.at_most(df, 9)
    assert "BroadcastHint" not in str(sizing.broadcast_if_small(df, 9)._jdf.queryExecution().logical())
    assert "broadcast" in str(sizing.broadcast_if_small(df, 10)._jdf.queryExecution().logical()).lower()


# -- a small base ------------------------------------------------------------

def observations(spark, rows):
    """rows: dicts; geometry under ``geom``."""
    names = {
        "id_synthese": "bigint", "unique_id_sinp": "string", "id_source": "int", "id_import": "int",
        "id_dataset": "int", "cd_nom": "int", "nom_cite": "string", "observers": "string",
        "date_min": "timestamp_ntz", "date_max": "timestamp_ntz", "count_min": "int", "count_max": "int",
        "altitude_min": "int", "altitude_max": "int", "id_nomenclature_valid_status": "int",
        "geom": GEOMETRY_DDL,
    }
    schema = ", ".join(f"{n} {t}" for n, t in names.items())
    return spark.createDataFrame(
        [tuple({"id_synthese": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], schema
    )


def report(spark, **lots):
    return spark.createDataFrame(
        [(name, name, name, listed) for name, listed in lots.items()],
        "report_id string, desc_source string, nom_fichier string, list_import string",
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_null_import_lots_match_only_rows_without_import(spark, make):
    ws = make(
        observation=observations(
            spark, [dict(id_source=4, id_import=i, id_dataset=1) for i in (None, None, 1)]
        ),
        dataset=spark.createDataFrame([(1, 9)], "id_dataset int, id_acquisition_framework int"),
        report=report(spark, bare="'4_'", one="'4_1', '4_1'", none="", ghost="'8_8'"),
    )
    assert rows(kpi.totals(ws)) == [
        ("bare", 2, 1, 1), ("ghost", 0, 0, 0), ("none", 0, 0, 0), ("one", 1, 1, 1),
    ]


def test_datasets_without_framework_drop_from_the_table_only(spark, make):
    ws = make(
        observation=observations(
            spark, [dict(id_source=1, id_import=1, id_dataset=d) for d in (1, 1, 2, 3)]
        ),
        dataset=spark.createDataFrame(
            [(1, "d1", 5), (2, "d2", None)],
            "id_dataset int, dataset_name string, id_acquisition_framework int",
        ),
        framework=spark.createDataFrame(
            [(5, "f")], "id_acquisition_framework int, acquisition_framework_name string"
        ),
        report=report(spark, r="1_1"),
    )
    assert rows(kpi.totals(ws)) == [("r", 3, 2, 1)]
    assert rows(metadata.dataset_table(ws)) == [("r", "f", "d1", None, 2)]
    assert rows(metadata.framework_table(ws)) == [("r", None, "f", 2)]


def test_mesh_counts_a_missing_name_once_and_takes_the_largest_lot(spark, make):
    ws = make(
        observation=observations(
            spark,
            [dict(id_source=1, id_import=1, cd_nom=t) for t in (1, 1, 2, 99, 98)]
            + [dict(id_source=1, id_import=2, cd_nom=3)],
        ),
        taxref=spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "cd_nom int, lb_nom string"),
        cor_area=spark.createDataFrame(
            [(i, 7) for i in range(6)] + [(0, 8), (0, 7), (5, 7)], "id_synthese bigint, id_area int"
        ),
        area=spark.createDataFrame(
            [(7, 27, "m", shapes.box(0, 0, 1, 1)), (8, 26, "d", None)],
            f"id_area int, id_type int, area_name string, geom_4326 {GEOMETRY_DDL}",
        ),
        area_type=spark.createDataFrame([(27, "M5")], "id_type int, type_code string"),
        report=report(spark, r="1_1, 1_2"),
    )
    stored = {r["lot_id"]: set(r["tab_lb_nom"]) for r in marts.mesh(ws).collect()}
    assert stored == {"1_1": {"a", "b", None}, "1_2": {"c"}}
    (cell,) = spatial.mesh_choropleth(ws).collect()
    assert (cell["id_area"], cell["nb_data"], cell["nb_esp"]) == (7, 6, 3)


def test_mesh_bounds_skip_unreadable_shapes(spark):
    df = spark.createDataFrame(
        [("r", 5, '{"type":"Point","coordinates":[1,2]}'), ("r", 9, "oops"), ("s", 1, None)],
        "report_id string, nb_data bigint, geojson string",
    )
    assert rows(layers.mesh_bounds(df)) == [
        ("r", 5, 9, 1.0, 2.0, 1.0, 2.0), ("s", 1, 1, None, None, None, None),
    ]


def test_point_layer_and_bounds(spark):
    df = spark.createDataFrame(
        [("r", 1.0, 2.0, "a"), ("r", 1.0, 2.0, "b"), ("r", None, 2.0, "c"), ("s", 0.0, 0.0, "d"), ("s", 3.0, 1.0, "e")],
        "report_id string, lat double, lon double, name string",
    )
    layer = layers.point_layer(df, ("name",))
    assert layer.columns == ["report_id", "lat", "lon", "name"] and layer.count() == 4
    assert rows(layers.point_bounds(layer)) == [
        ("r", 2, 1.0, 2.0, 1.0, 2.0, True), ("s", 2, 0.0, 0.0, 3.0, 1.0, False),
    ]


# -- reports ---------------------------------------------------------------

def test_report_list(spark, make):
    ws = make(
        params=dict(report_url="https://example.org/"),
        observation=observations(
            spark,
            [dict(id_source=7, id_import=1), dict(id_source=7, id_import=2), dict(id_source=8, id_import=1),
             dict(id_source=9, id_import=None), dict(id_source=9, id_import=3), dict(id_source=6, id_import=4)],
        ),
        **{
            "import": spark.createDataFrame(
                [(1, dt.datetime(2024, 1, 1), '{"desc_source": "Lot É", "create_rapport": true}'),
                 (2, dt.datetime(2024, 5, 1), '{"desc_source": "Lot É", "create_rapport": "true"}'),
                 (3, dt.datetime(2024, 6, 1), '{"desc_source": "x", "create_rapport": "false"}'),
                 (4, dt.datetime(2024, 6, 1), None)],
                "id_import int, date_create_import timestamp_ntz, additional_data string",
            )
        },
        source=spark.createDataFrame(
            [(9, "S[9]", dt.datetime(2023, 1, 1), '{"create_rapport": true}'), (8, "S8", None, "{}")],
            "id_source int, desc_source string, meta_update_date timestamp_ntz, additional_data string",
        ),
    )
    assert rows(reports.report_list(ws)) == [
        ("import:Lot É", "Lot É", "lot_é", dt.datetime(2024, 5, 1), "'7_1', '7_2', '8_1'", "https://example.org/lot_e.html"),
        ("source:S[9]", "S[9]", "s9", dt.datetime(2023, 1, 1), "'9_'", "https://example.org/s9.html"),
    ]


def test_select_reports(spark):
    df = report(spark, A=" ", Ab=" ").withColumn("nom_fichier", F.concat(F.lit(" "), "report_id"))
    assert [r[0] for r in reports.select_reports(df, " A ").collect()] == ["A"]
    assert reports.select_reports(df, "a").count() == 0
    assert reports.select_reports(df, "a", mode="contains").count() == 2
    with pytest.raises(ValueError):
        reports.select_reports(df, "a", mode="other")


# -- dates -----------------------------------------------------------------

def test_dates_are_split_as_a_nanosecond_clock_would(spark, make):
    months = [(1500, 3), (1599, 12), (1600, 1), (1676, 2), (1677, 9), (1677, 10), (1999, 10), (2262, 4), (2262, 5), None]
    ws = make(
        observation=observations(
            spark,
            [dict(id_source=1, id_import=1, cd_nom=1, date_min=m and dt.datetime(*m, 21)) for m in months]
            + [dict(id_source=1, id_import=1, cd_nom=2, date_min=dt.datetime(2000, 1, 1))],
        ),
        taxref=spark.createDataFrame([(1,)], "cd_nom int"),
        report=report(spark, r="1_1"),
    )
    assert [r["an"] for r in temporal.by_year(ws).collect()] == [1500, 1599, 1600, 1676, 1677, 1999, 2262, None]
    assert [(r["date2"], r["date"]) for r in temporal.by_month(ws).collect()] == [
        ("1677-10", "1677-10"), ("1999-10", "1999-10"), ("2262-04", "2262-4"),
    ]
    assert rows(temporal.ancient_rows(ws)) == [("r", 1500, 3, 1), ("r", 1599, 12, 1)]
    assert rows(temporal.implausible_dates(ws)) == [
        ("r", 4, ["1600-1", "1676-2", "1677-9", "2262-5"]),
    ]


# -- altitudes and sizes -----------------------------------------------------

@pytest.mark.parametrize(
    "low, high, label, order, valid",
    [
        (-1, 10, "< 0", 0, "incorrect"),
        (0, 60, "0-40", 1, "incorrect"),
        (40, 40, "40-250", 2, "correct"),
        (100, None, "40-250", 2, "incorrect"),
        (250, 300, "250-500", 3, "correct"),
        (2499, 2600, "2250-2500", 11, "correct"),
        (2500, 2600, "2500-2750", 12, "correct"),
        (None, 300, "2500-2750", 12, "incorrect"),
        (2500, 4749, "4500-4750", 20, "correct"),
        (2600, 4750, "Autres", -2, "correct"),
        (2600, 4751, "> 4750", 21, "incorrect"),
        (2600, None, "Sans donnees", -1, "incorrect"),
        (None, None, "Sans donnees", -1, "incorrect"),
    ],
)
def test_altitude_class(spark, make, low, high, label, order, valid):
    ws = make(
        observation=observations(spark, [dict(id_source=1, id_import=1, altitude_min=low, altitude_max=high)]),
        report=report(spark, r="1_1"),
    )
    assert rows(spatial.altitude_profile(ws)) == [("r", label, order, valid, 1)]
    assert rows(spatial.altitude_alert(ws)) == ([("r", 1)] if valid == "incorrect" else [])


def test_altitude_labels_are_complete():
    labels = spatial.altitude_classes()
    assert len(labels) == 24 and labels[11] == "2250-2500" and labels[12] == "2500-2750"
    assert labels[20] == "4500-4750" and labels[21] == "> 4750"


def test_geometry_kinds_and_sizes(spark, make):
    geoms = [
        shapes.line((0, 0), (99, 0)), shapes.line((0, 0), (100, 0)), shapes.line((0, 0), (20000, 0)),
        shapes.box(0, 0, 10, 10), shapes.box(0, 0, 5000, 5000), shapes.point(0, 0),
        shapes.geom("GEOMETRYCOLLECTION", ("POINT", [[(0, 0)]])), None,
    ]
    ws = make(
        observation=observations(spark, [dict(id_source=1, id_import=None, geom=g) for g in geoms]),
        report=report(spark, r="1_", twice="1_"),
    )
    assert rows(spatial.geometry_types_total(ws).filter("report_id = 'r'")) == [
        ("r", "Autre", 1), ("r", "Lignes", 3), ("r", "Points", 1), ("r", "Polygones", 2), ("r", "Sans geometrie", 1),
    ]
    assert rows(spatial.geometry_types(ws).filter("report_id = 'twice' and type_geom = 'Points'")) == [
        ("twice", 1, None, "Points", 1)
    ]
    assert rows(spatial.geometry_sizes(ws).filter("report_id = 'r'")) == [
        ("r", "Lignes", "100 m - 1 km", 2, False, 1),
        ("r", "Lignes", "< 100 m", 1, False, 1),
        ("r", "Lignes", "> 20 km", 5, True, 1),
        ("r", "Polygones", "< 0,1 ha", 1, False, 1),
        ("r", "Polygones", "> 2500 ha", 6, True, 1),
    ]
    assert rows(spatial.imprecise_total(ws)) == [("r", 2), ("twice", 2)]


def test_size_labels_follow_the_limits():
    from lotscope.model import Params

    limits = spatial.size_limits(Params(line_limit_km=7.5, area_limit_ha=300))
    assert [label for _, label in limits["Lignes"]][3:] == ["5 - 7.5 km", "> 7.5 km"]
    assert [label for _, label in limits["Polygones"]][4:] == ["100 - 300 ha", "> 300 ha"]


# -- region ----------------------------------------------------------------

REGION = shapes.polygon(
    [(0, 0), (60000, 0), (60000, 60000), (30000, 20000), (0, 60000), (0, 0)],
    [(10000, 5000), (10000, 15000), (25000, 15000), (25000, 5000), (10000, 5000)],
)


def region_area(spark, *named):
    return spark.createDataFrame(
        [(i, 28, name, g) for i, name, g in named],
        f"id_area int, id_type int, area_name string, geom {GEOMETRY_DDL}",
    )


def test_outside_region_matches_brute_force(spark, make):
    rng = random.Random(3)
    points = [shapes.point(rng.uniform(-12000, 72000), rng.uniform(-12000, 72000)) for _ in range(500)]
    points += [shapes.point(65000, 30000), shapes.point(-5000, 0), shapes.point(-5000.001, 0), None]
    ws = make(
        observation=observations(spark, [dict(id_source=1, id_import=1, geom=g) for g in points]),
        area=region_area(
            spark, (5, "AUVERGNE-RHONE-ALPES", REGION), (9, "Auvergne-Rhône-Alpes", shapes.box(-1e6, -1e6, 1e6, 1e6))
        ),
        report=report(spark, r="1_1"),
    )
    got = {r["id_synthese"] for r in spatial.outside_region(ws).collect()}
    want = {i for i, g in enumerate(points) if g and shapes.distance(g, REGION) > 5000}
    assert 50 < len(want) < 450 and got == want


def test_outside_region_needs_a_region(spark, make):
    ws = make(
        observation=observations(spark, [dict(id_source=1, id_import=1, geom=shapes.point(0, 0))]),
        area=region_area(spark, (5, "Elsewhere", REGION)),
        report=report(spark, r="1_1"),
    )
    assert spatial.outside_region(ws).count() == 0


def test_area_index_finds_every_meeting_of_any_shapes(spark):
    rng = random.Random(11)
    from test_geometry import random_shape

    zones = [random_shape(rng, 60) for _ in range(12)]
    zones = [z for z in zones if z[0] == "POLYGON"] + [REGION_SMALL]
    things = [random_shape(rng, 60) for _ in range(250)] + [shapes.box(-5, -5, 80, 80), None]
    areas = spark.createDataFrame(list(enumerate(zones)), f"id int, geom {GEOMETRY_DDL}")
    df = spark.createDataFrame(list(enumerate(things)), f"i int, geom {GEOMETRY_DDL}")
    for reach, rows_limit in ((0.0, 10**6), (1.5, 0)):
        index = area_index.build(areas, "id", 4.0, reach, rows_limit)
        found = (
            index.cells_of(df, "geom")
            .join(index.cells, ["cx", "cy"], "left")
            .filter(index.hit_geometry(F.col("geom")))
            .select("i", "id")
            .distinct()
        )
        got = {(r["i"], r["id"]) for r in found.collect()}
        want = {
            (i, j) for i, g in enumerate(things) if g for j, z in enumerate(zones)
            if shapes.distance(g, z) <= reach
        }
        assert got == want and len(want) > 100


REGION_SMALL = shapes.polygon(
    [(0, 0), (60, 0), (60, 60), (30, 20), (0, 60), (0, 0)],
    [(10, 5), (10, 15), (25, 15), (25, 5), (10, 5)],
)


def test_area_index_keeps_rows_without_cells_once(spark):
    areas = spark.createDataFrame([(1, shapes.box(0, 0, 10, 10))], f"id int, geom {GEOMETRY_DDL}")
    df = spark.createDataFrame(
        [(1, None), (2, shapes.point(1e7, 1e7)), (3, shapes.box(-1e9, -1e9, 1e9, 1e9))], f"i int, geom {GEOMETRY_DDL}"
    )
    index = area_index.build(areas, "id", 5.0, 0.0, 1000)
    cells = index.cells_of(df, "geom")
    assert cells.filter("i < 3").count() == 2
    assert cells.filter("i = 3").count() <= 25
    empty = area_index.build(areas.limit(0), "id", 5.0, 0.0, 1000)
    assert empty.extent is None and empty.cells_of(df, "geom").count() == 3


# -- taxonomy ----------------------------------------------------------------

def fold(spark, pairs, **options):
    df = spark.createDataFrame([("r", *p) for p in pairs], "report_id string, g string, n bigint")
    folded = taxonomy.fold_small(df, "g", "n", **options)
    return [(r["g"], r["n"]) for r in folded.orderBy("position").collect()]


def test_fold_small_categories(spark):
    assert fold(spark, [("a", 90), ("b", 9), ("c", 1)]) == [("a", 90), ("b", 9), ("c", 1)]
    assert fold(spark, [("a", 97), ("b", 1), ("c", 2)]) == [("a", 97), ("c", 2), ("b", 1)]
    assert fold(spark, [("a", 98), ("b", 1), ("c", 1)]) == [("a", 98), ("Autres", 2)]
    even = [(chr(97 + i), 10) for i in range(12)]
    assert fold(spark, even)[-1] == ("Autres", 20) and len(fold(spark, even)) == 11
    assert len(fold(spark, even[:11])) == 11
    assert fold(spark, [("a", 0), ("b", 0)]) == [("a", 0), ("b", 0)]
    assert fold(spark, [(None, 50), ("b", 50)]) == [("b", 50), (None, 50)]
    assert fold(spark, []) == []


def test_rank_shares(spark, make):
    ws = make(
        observation=observations(
            spark,
            [dict(id_source=1, id_import=1, cd_nom=t) for t in (1, 1, 2, 3)]
            + [dict(id_source=2, id_import=1, cd_nom=2) for _ in range(4)],
        ),
        taxref=spark.createDataFrame(
            [(1, 1, "ES", "birds"), (2, 2, "GN", "birds"), (3, 1, "ES  ", None)],
            "cd_nom int, cd_ref int, id_rang string, group2_inpn string",
        ),
        rank=spark.createDataFrame([("ES  ", "Species"), ("GN  ", "Genus")], "id_rang string, nom_rang string"),
        source=spark.createDataFrame([(1,), (2,)], "id_source int"),
        report=report(spark, r="1_1"),
    )
    assert rows(taxonomy.rank_shares(ws)) == [("r", "Genus", 1, 0.25, 0.625), ("r", "Species", 3, 0.75, 0.375)]
    assert rows(taxonomy.species_by_group(ws)) == [("r", "birds", 1), ("r", None, 1)]
    assert rows(taxonomy.records_by_group(ws)) == [("r", "birds", 2), ("r", None, 1)]
    assert rows(kpi.taxa(ws)) == [("r", 2, 1)]


# -- validation ----------------------------------------------------------------

def validations(spark, rows):
    return spark.createDataFrame(
        rows, "id_validation bigint, uuid_attached_row string, id_nomenclature_valid_status int, validation_date timestamp_ntz"
    )


def day(n):
    return dt.datetime(2024, 1, n)


def test_latest_validation_keeps_ties_and_drops_unknowns(spark, make):
    ws = make(
        validation=validations(
            spark,
            [(1, "a", 1, day(1)), (2, "a", 2, day(2)), (3, "a", 3, day(2)), (4, "a", 1, None),
             (5, None, 1, day(9)), (6, "b", 1, None)],
        )
    )
    assert sorted(r[0] for r in validation.latest_validation(ws).collect()) == [2, 3]


def review_base(spark, make, codes):
    return make(
        observation=observations(
            spark,
            [dict(unique_id_sinp=u, id_source=1, id_import=1, cd_nom=1, id_nomenclature_valid_status=s)
             for u, s in (("a", 10), ("b", 40), ("c", None), ("d", 40), ("e", 99))],
        ),
        taxref=spark.createDataFrame([(1, 1, "ES")], "cd_nom int, cd_ref int, id_rang string"),
        rank=spark.createDataFrame([("ES  ", "Species")], "id_rang string, nom_rang string"),
        nomenclature=spark.createDataFrame(
            codes, "id_nomenclature int, type_code string, cd_nomenclature string, label_default string"
        ),
        validation=validations(
            spark, [(1, "a", 40, day(1)), (2, "b", 10, day(1)), (3, "c", 40, day(1)), (4, "d", None, day(1)), (5, "e", 40, day(1))]
        ),
        report=report(spark, r="1_1"),
    )


CODES = [(10, "STATUT_VALID", "0", "zero"), (20, "STATUT_VALID", "1", "one"), (30, "STATUT_VALID", "2", "two"),
         (40, "STATUT_VALID", "3", "three"), (50, "SEXE", "2", "other")]


def test_to_review(spark, make):
    ws = review_base(spark, make, CODES)
    assert [(r["uuid"], r["label_valid_status"], r["date_commentaire"]) for r in validation.to_review(ws).collect()] == [
        ("a", "zero", "2024-01-01")
    ]
    assert rows(validation.status_mix(ws)) == [("r", "three", 2), ("r", "zero", 1), ("r", None, 2)]


def test_to_review_is_empty_when_an_advised_status_is_unknown(spark, make):
    assert validation.to_review(review_base(spark, make, CODES[:2] + CODES[3:])).count() == 0


def test_history_of_other_records_goes_before_it_is_aggregated(spark, make):
    ws = make(validation=validations(
        spark, [(1, "a", 1, day(1)), (2, "a", 2, day(2)), (3, "a", 3, day(2)), (4, "b", 1, day(3)), (5, None, 1, day(9))],
    ))
    records = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "uuid string")
    latest = validation.latest_validation(ws, records)
    assert sorted(r[0] for r in latest.collect()) == [2, 3]
    plan = latest._jdf.queryExecution().optimizedPlan().toString()
    # Both readings of the history, the aggregated one and the other, are cut first.
    assert plan.count("Join LeftSemi") == 2
    assert plan.index("Aggregate") < plan.rindex("Join LeftSemi")


# -- duplicates ----------------------------------------------------------------

def test_duplicates_within_a_report(spark, make):
    base = dict(id_source=1, id_import=1, cd_nom=1, observers="o", count_min=1, count_max=2, date_min=day(1))
    same = [dict(geom=shapes.point(1, 1)), dict(geom=shapes.point(1.0000001, 1)),
            dict(geom=shapes.point(1, 1), date_max=day(5), id_dataset=4, id_import=2)]
    other = [dict(geom=shapes.point(1.1, 1)), dict(geom=shapes.point(1, 1), observers="p"),
             dict(geom=shapes.line((1, 0), (1, 2))), dict(geom=shapes.point(1, 1), date_min=dt.datetime(2024, 1, 1, 12))]
    bare = [dict(geom=None), dict(geom=None)]
    ws = make(
        observation=observations(spark, [{**base, **d} for d in same + other + bare]),
        report=report(spark, both="1_1, 1_2", first="1_1"),
    )
    got = {(r["report_id"], r["geom_type"], r["nb_data_similaire"]) for r in duplicates.within_report(ws).collect()}
    assert got == {("both", "POINT", 3), ("first", "POINT", 2), ("both", None, 2), ("first", None, 2)}


def brute_across(records, lots, reach=1.0, name=lambda r: f"s{r['id_source']}"):
    out = {}
    for report_id, covered in lots.items():
        pairs: dict[str, list[int]] = {}
        for r in records:
            if (r["id_source"], r["id_import"]) not in covered or not r["geom"]:
                continue
            for s in records:
                if not s["geom"] or (r["id_source"], r["id_import"]) == (s["id_source"], s["id_import"]):
                    continue
                if r["cd_nom"] is None or r["cd_nom"] != s["cd_nom"] or r["date_min"] != s["date_min"]:
                    continue
                if shapes.distance(r["geom"], s["geom"]) <= reach:
                    pairs.setdefault(name(s), []).append(s["id_synthese"])
        for n, ids in pairs.items():
            if len(ids) > 1:
                out[report_id, n] = (len(set(ids)), len(ids))
    return out


def across_case(spark, make, records, lots):
    listed = {
        name: ", ".join(f"{s}_{'' if i is None else i}" for s, i in covered) for name, covered in lots.items()
    }
    ws = make(
        observation=observations(spark, records),
        source=spark.createDataFrame([(i, f"s{i}") for i in range(5)], "id_source int, desc_source string"),
        report=report(spark, **listed),
    )
    return {
        (r["report_id"], r["nom_source"]): (r["nombre_donnees_dupliquees"], r["nb_paires"])
        for r in duplicates.across_lots(ws).collect()
    }


def test_duplicates_across_lots_match_brute_force(spark, make):
    from test_geometry import random_shape

    rng = random.Random(5)
    records = []
    for i in range(420):
        g = random_shape(rng, 14)
        if i % 40 == 0:
            x = rng.uniform(0, 5)
            g = rng.choice([shapes.box(x, x, x + 300, x + 200), shapes.line((x, 0), (x + 9000, 9000))])
        records.append(
            dict(id_synthese=i, id_source=rng.randrange(4), id_import=rng.choice([None, 1, 2]),
                 cd_nom=rng.choice([1, 1, 2, None]), date_min=rng.choice([day(1), day(2)]), geom=None if i % 50 == 7 else g)
        )
    lots = {"all": [(s, i) for s in range(4) for i in (None, 1, 2)], "some": [(0, None), (3, 1)], "none": []}
    want = brute_across(records, lots)
    assert len(want) >= 6
    assert across_case(spark, make, records, lots) == want


def test_duplicates_across_lots_with_one_hot_place(spark, make):
    """A third of all records are copies at one place: counted, never paired up."""
    hot = [
        dict(id_synthese=i, id_source=i % 3, id_import=i % 5, cd_nom=1, date_min=day(1), geom=shapes.point(3, 3))
        for i in range(30000)
    ]
    rng = random.Random(1)
    rest = [
        dict(id_synthese=30000 + i, id_source=i % 3, id_import=1, cd_nom=rng.randrange(50), date_min=day(1 + i % 9),
             geom=shapes.point(1000 + rng.uniform(0, 1e5), rng.uniform(0, 1e5)))
        for i in range(3000)
    ]
    got = across_case(spark, make, hot + rest, {"r": [(0, 0)]})
    # 15 lots of 2 000 copies; the report covers one of them.
    assert got["r", "s0"] == (8000, 8000 * 2000)
    assert got["r", "s1"] == (10000, 10000 * 2000) == got["r", "s2"]


def test_duplicates_across_lots_in_a_crowded_square(spark, make, monkeypatch):
    """Distinct points within one square are counted by lot; others meet in shares."""
    monkeypatch.setattr(duplicates, "_TESTS", 40)
    rng = random.Random(8)
    records = [
        dict(id_synthese=i, id_source=i % 3, id_import=i % 2, cd_nom=1, date_min=day(1),
             geom=shapes.point(rng.uniform(0, 3), rng.uniform(0, 2)) if i % 9 else shapes.box(1, 1, 1.5, 1.2))
        for i in range(240)
    ]
    lots = {"r": [(0, 0), (1, 1)], "q": [(2, 0)]}
    assert across_case(spark, make, records, lots) == brute_across(records, lots)
    # Too many to be compared: 100 000 distinct points in one square, a third of one lot.
    crowd = spark.range(100_000).select(
        F.col("id").alias("id_synthese"), (F.col("id") % 3).cast("int").alias("id_source"), F.lit(1).alias("id_import"),
        F.lit(1).alias("cd_nom"), F.lit(day(1)).cast("timestamp_ntz").alias("date_min"),
        geometry.point(10.0 + F.col("id") % 317 / 1000.0, 10.0 + F.col("id") / 317 / 1000.0).alias("geom"),
    )
    ws = make(
        observation=crowd, report=report(spark, r="0_1"),
        source=spark.createDataFrame([(i, f"s{i}") for i in range(3)], "id_source int, desc_source string"),
    )
    got = {r["nom_source"]: (r["nombre_donnees_dupliquees"], r["nb_paires"]) for r in duplicates.across_lots(ws).collect()}
    assert got == {f"s{i}": (33333, 33333 * 33334) for i in (1, 2)}
    plan = duplicates.across_lots(ws)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


def test_duplicates_across_lots_of_shapes_from_one_corner(spark, make):
    """Boxes and lines whose first vertex lies in one small square form one spot: counted by lot,
    with no pair of places compared."""
    records = [
        dict(id_synthese=i, id_source=i % 3, id_import=i % 2, cd_nom=1, date_min=day(1),
             geom=shapes.box(i % 4 * 0.1, 0, 5 + i, 3 + i % 7) if i % 3 else shapes.line((0.2, i % 5 * 0.1), (40 + i, 9)))
        for i in range(60)
    ]
    lots = {"r": [(0, 0), (1, 1)], "q": [(2, 0)]}
    assert across_case(spark, make, records, lots) == brute_across(records, lots)
    ws = make(
        observation=observations(spark, records), report=report(spark, r="0_0, 1_1"),
        source=spark.createDataFrame([(i, f"s{i}") for i in range(5)], "id_source int, desc_source string"),
    )
    found = duplicates.placed(ws)
    assert duplicates.close_places(ws, duplicates.places(ws, found)).count() == 0


def test_duplicates_of_the_import_module_are_named_by_the_import(spark, make):
    records = [
        dict(id_source=1, id_import=1, cd_nom=1, date_min=day(1), geom=shapes.point(0, 0)),
        dict(id_source=3, id_import=2, cd_nom=1, date_min=day(1), geom=shapes.point(1, 0)),
        dict(id_source=3, id_import=2, cd_nom=1, date_min=day(1), geom=shapes.point(0, 0.5)),
        dict(id_source=3, id_import=None, cd_nom=1, date_min=day(1), geom=shapes.point(0, 0.5)),
    ]
    ws = make(
        params=dict(import_source_id=3),
        observation=observations(spark, records),
        source=spark.createDataFrame([(1, "one"), (3, "module")], "id_source int, desc_source string"),
        report=report(spark, r="1_1"),
        **{"import": spark.createDataFrame([(2, '{"desc_source": "file"}')], "id_import int, additional_data string")},
    )
    assert rows(duplicates.across_lots(ws)) == [("r", "file", 2, 2)]
    assert rows(duplicates.alert_counts(ws)) == [("r", 0, 1)]


@pytest.mark.parametrize(("lots", "distance"), [(((None, 7), (1, 7)), 5.0), (((1, -1), (1, None)), 5.0), (((2, 1), (1, 1)), 0.0)])
def test_lots_differ_by_their_identifier_and_distance_may_be_zero(spark, make, lots, distance):
    (s0, i0), (s1, i1) = lots
    at = shapes.box(0, 0, 1, 1)
    records = [dict(id_source=s, id_import=i, cd_nom=1, date_min=day(1), geom=at) for s, i in ((s0, i0), (s1, i1), (s1, i1))]
    ws = make(
        params=dict(duplicate_distance_m=distance),
        observation=observations(spark, records),
        source=spark.createDataFrame([(1, "one"), (2, "two")], "id_source int, desc_source string"),
        report=report(spark, r="_7" if s0 is None else f"{s0}_{i0}"),
        **{"import": spark.createDataFrame([], "id_import int, additional_data string")},
    )
    assert rows(duplicates.across_lots(ws)) == [("r", "one", 2, 2)]


def test_accents_fold_beyond_latin_1(spark):
    df = one_column(spark, ["Žďár Łódź Kőszeg", "ạặ Ẁ đ"])
    assert column(df, text.safe_file_name(F.col("v"))) == ["Zdar_Lodz_Koszeg", "aa_W_d"]


# -- invasive taxa ---------------------------------------------------------------

def test_new_presence_rule(spark):
    cases = {
        ("aura", True, True): "Non", ("RA", False, True): "Oui", ("RA", True, False): "Non",
        ("Au", True, False): "Oui", ("Au", False, True): "Non", ("Absente", False, False): "Oui",
        (None, True, True): "Non", ("ailleurs", True, True): "Non",
    }
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, p string, ra boolean, au boolean")
    assert column(df, invasive.new_presence(F.col("p"), F.col("ra"), F.col("au"))) == list(cases.values())


def test_invasive_summary(spark, make):
    ws = make(
        params=dict(invasive_lots=("1_1",)),
        observation=observations(
            spark,
            [dict(id_source=1, id_import=1, cd_nom=10, count_min=2, count_max=3, date_min=day(2), date_max=day(3), geom=g)
             for g in (shapes.point(5, 5), shapes.box(4, 4, 25000, 6), None)]
            + [dict(id_source=1, id_import=1, cd_nom=11, geom=shapes.point(5, 5)),
               dict(id_source=1, id_import=2, cd_nom=10, geom=shapes.point(5, 5))],
        ),
        taxref=spark.createDataFrame(
            [(10, 10, "name", "vern"), (11, 10, "synonym", "vern")], "cd_nom int, cd_ref int, lb_nom string, nom_vern string"
        ),
        invasive=spark.createDataFrame([(11, "RA"), (77, "Au")], "cd_nom int, presence string"),
        area=region_area(
            spark, (1, "Auvergne-Rhône-Alpes", shapes.box(0, 0, 30000, 30000)),
        ).unionByName(
            spark.createDataFrame(
                [(2, 26, "Ain", shapes.box(0, 0, 10, 10)), (3, 26, "Cantal", shapes.box(20000, 0, 30000, 10)),
                 (4, 27, "Loire", shapes.box(0, 0, 1e6, 1e6)), (5, 26, "Paris", shapes.box(0, 0, 1e6, 1e6))],
                f"id_area int, id_type int, area_name string, geom {GEOMETRY_DDL}",
            )
        ),
    )
    # Listed under a synonym, found under the reference name only.
    (row,) = invasive.summary(ws).collect()
    assert tuple(row) == ("vern", "synonym", 10, "RA", "Au, RA", "Oui", 3, day(2), day(3), 2, 3)
    got = {(r["secteur_obs"], r["lat"] is None) for r in invasive.points(ws).collect()}
    assert got == {("RA", False), ("Au, RA", False), (None, True)}
    assert rows(invasive.new_presence_count(ws)) == [(1, True)]
