"""Observation tables derived from the sales-like test tables, by the rules of
FIXTURES.md: every expression also has a plain SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotscope.functions import geometry as geo
from lotscope.model import PARTS_DDL, SCHEMAS, Params, Tables, struct_type

ORIGIN_X, ORIGIN_Y = 700000.0, 6400000.0
MESH_M = 5000
MESH_COLUMNS, MESH_ROWS = 36, 48
IMPORTS = ("", "0", "1", "2", "3", "4", "5")
ALL_LOTS = tuple(f"{source}_{imported}" for source in range(10) for imported in IMPORTS)

TEST_PARAMS = Params(
    import_source_id=3,
    invasive_lots=ALL_LOTS,
    dataset_url="https://example.org/dataset/",
    report_url="https://example.org/",
)

# name, id_type, x1, y1, x2, y2 (metres)
AREAS = (
    (1, "Auvergne-Rhône-Alpes", 28, 700000.0, 6400000.0, 820000.0, 6560000.0),
    (2, "Ain", 26, 760000.0, 6400000.0, 820000.0, 6560000.0),
    (3, "Isere", 26, 790000.0, 6500000.0, 860000.0, 6600000.0),
    (4, "Allier", 26, 700000.0, 6400000.0, 740000.0, 6480000.0),
    (5, "Paris", 26, 700000.0, 6400000.0, 900000.0, 6700000.0),
    (6, "Auvergne-Rhône-Alpes (bis)", 28, 850000.0, 6600000.0, 900000.0, 6700000.0),
)
FIRST_CELL_ID = 1000

SOURCES = tuple(
    (
        i,
        f"Source {i}",
        (f"Données [réseau] n°{i}/{i % 3}" if i % 2 == 0 else f"Suivi Éclair {i}"),
        f"2024-0{i % 9 + 1}-15 00:00:00",
        ('{"create_rapport": true}' if i % 3 == 0 else None if i == 7 else '{"create_rapport": false}'),
    )
    for i in range(10)
)
IMPORT_ROWS = tuple(
    (
        i,
        f"2025-0{i + 1}-01 08:00:00",
        (
            '{"desc_source": "Lot partagé œuvre", "create_rapport": true}' if i in (1, 2)
            else '{"desc_source": "Import / Été [%d]", "create_rapport": "true"}' % i if i == 3
            else '{"desc_source": "Import %d", "create_rapport": false}' % i
        ),
    )
    for i in range(6)
)
RANKS = (
    ("ES  ", "Espèce"), ("SSES", "Sous-espèce"), ("GN  ", "Genre"),
    ("FM  ", "Famille"), ("OR  ", "Ordre"),
)
RANK_CODES = ("ES", "SSES", "GN", "FM", "OR")
STATUSES = (
    (1, "STATUT_VALID", "0", "En attente de validation"),
    (2, "STATUT_VALID", "1", "Certain - très probable"),
    (3, "STATUT_VALID", "2", "Probable"),
    (4, "STATUT_VALID", "3", "Douteux"),
    (5, "STATUT_VALID", "4", "Invalide"),
    (6, "SEXE", "0", "Inconnu"),
)
INVASIVE = tuple(
    (cd_nom, ("RA", "Au", "AuRA", "Absente", None)[cd_nom // 3 % 5]) for cd_nom in range(1, 60, 2)
)
REPORTS = (
    ("all", "Toute la base", "toute_la_base", ", ".join(f"'{lot}'" for lot in ALL_LOTS)),
    ("source3", "Source trois", "source_trois", ", ".join(f"'3_{i}'" for i in IMPORTS)),
    ("mixed", "Mélange", "melange", "'4_', '5_2' , \"3_1\",, '3_1'"),
    ("empty", "Vide", "vide", ""),
)


def _literal(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A few constant rows, kept in the plan as such: their size is then known."""

    def sql(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v}D" if isinstance(v, float) else str(v)

    fields = T.StructType.fromDDL(schema).fields
    values = ", ".join("(" + ", ".join(sql(v) for v in row) + ")" for row in rows)
    names = ", ".join(f.name for f in fields)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})").select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]
    )


def _shaped(df: DataFrame, table: str) -> DataFrame:
    """Columns cast to the declared types, in the declared order."""
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in struct_type(table).fields]
    )


def local_position(custkey: Column, orderkey: Column) -> tuple[Column, Column]:
    x = F.lit(ORIGIN_X) + (custkey % 60) * 3000 + (orderkey % 4) * F.lit(0.4)
    y = F.lit(ORIGIN_Y) + (custkey % 60) * 4000
    return x, y


def observation(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = local_position(c, k)
    w, h = ((k % 7) * 5000 + 50).cast("double"), ((k % 11) * 600 + 10).cast("double")
    kind = k % 10
    date_min = (
        F.when(k % 501 == 0, F.lit("1500-03-01").cast("date").cast("timestamp_ntz"))
        .when(k % 503 == 0, F.lit("1650-02-01").cast("date").cast("timestamp_ntz"))
        .when(k % 509 == 0, F.lit("1677-03-01").cast("date").cast("timestamp_ntz"))
        .otherwise(F.col("o_orderdate").cast("timestamp_ntz"))
    )
    altitude = F.floor(F.col("o_totalprice") / 100) - 100
    located, extended = kind != 9, (kind >= 6) & (kind <= 8)
    x2, y2 = F.when(extended, x + w).otherwise(x), F.when(extended, y + h).otherwise(y)
    parts = F.when(kind == 6, F.array(geo.part("LINESTRING", geo.ring((x, y), (x + w, y + h))))).when(
        extended,
        F.array(
            geo.part(
                "POLYGON",
                geo.ring((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)),
            )
        ),
    )
    family = F.when(kind <= 5, "POINT").when(kind == 6, "LINESTRING").when(kind <= 8, "POLYGON")
    # One struct of separate fields, not a choice of structs: reading the kind or the
    # box then costs no more than these expressions.
    shape = F.struct(
        family.alias("kind"),
        F.when(located, x).alias("xmin"), F.when(located, y).alias("ymin"),
        F.when(located, x2).alias("xmax"), F.when(located, y2).alias("ymax"),
        parts.cast(PARTS_DDL).alias("parts"),
    )
    status = F.substring("o_orderpriority", 1, 1).cast("int")
    rows = orders.withColumn("date_min", date_min).select(
        k.alias("id_synthese"),
        F.concat(F.lit("u-"), k.cast("string")).alias("unique_id_sinp"),
        (c % 10).alias("id_source"),
        F.when(c % 4 != 0, k % 6).alias("id_import"),
        (c % 25).alias("id_dataset"),
        (c % 60).alias("cd_nom"),
        F.concat(F.lit("taxon "), (c % 60).cast("string")).alias("nom_cite"),
        F.col("o_orderstatus").alias("observers"),
        "date_min",
        (F.col("date_min") + F.make_dt_interval((k % 30).cast("int"))).alias("date_max"),
        (k % 2 + 1).alias("count_min"),
        (k % 2 + 4).alias("count_max"),
        F.when(k % 31 != 0, altitude).alias("altitude_min"),
        F.when(k % 37 != 0, altitude + (k % 5) * 10).alias("altitude_max"),
        (k % 2).alias("id_nomenclature_sex"),
        F.lit(1).alias("id_nomenclature_obs_technique"),
        F.lit(1).alias("id_nomenclature_life_stage"),
        F.when(k % 41 != 0, status).alias("id_nomenclature_valid_status"),
        shape.alias("geom"),
    )
    return _shaped(rows, "observation")


def validation(orders: DataFrame) -> DataFrame:
    """A history of one to three validations for every third order."""
    k = F.col("o_orderkey")
    steps = (
        F.when(k % 27 == 0, F.array(*[F.lit(i) for i in (0, 1, 2)]))
        .when(k % 9 == 0, F.array(F.lit(0), F.lit(1)))
        .when(k % 3 == 0, F.array(F.lit(0)))
    )
    step = F.col("step")
    rows = (
        orders.withColumn("step", F.explode(steps))
        .select(
            (k * 3 + step).alias("id_validation"),
            # A few histories have no record, and a few no date.
            F.when(k % 81 != 0, F.concat(F.lit("u-"), k.cast("string"))).alias("uuid_attached_row"),
            ((k + step) % 5 + 1).alias("id_nomenclature_valid_status"),
            F.lit(False).alias("validation_auto"),
            (k % 13).alias("id_validator"),
            F.concat(F.lit("avis "), step.cast("string")).alias("validation_comment"),
            # The third step is dated as the second: a tie.
            F.when(
                k % 33 != 0,
                F.col("o_orderdate").cast("timestamp_ntz")
                + F.make_dt_interval(F.least(step, F.lit(1)).cast("int")),
            ).alias("validation_date"),
        )
    )
    return _shaped(rows, "validation")


def _degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Any fixed rule will do for the stored WGS84 shapes of the cells."""
    return (x - 700000.0) / 80000.0 + 3.0, (y - 6600000.0) / 100000.0 + 46.5


def area(spark: SparkSession) -> DataFrame:
    named = _literal(
        spark, AREAS,
        "id_area int, area_name string, id_type int, x1 double, y1 double, x2 double, y2 double",
    )
    column, row = F.col("id") % MESH_COLUMNS, F.floor(F.col("id") / MESH_COLUMNS)
    x, y = F.lit(ORIGIN_X) + column * MESH_M, F.lit(ORIGIN_Y) + row * MESH_M
    cells = spark.range(MESH_COLUMNS * MESH_ROWS).select(
        (F.col("id") + FIRST_CELL_ID).cast("int").alias("id_area"),
        F.concat(F.lit("cell "), F.col("id").cast("string")).alias("area_name"),
        F.lit(27).alias("id_type"),
        x.alias("x1"), y.alias("y1"), (x + MESH_M).alias("x2"), (y + MESH_M).alias("y2"),
    )
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    rows = named.unionByName(cells).select(
        "id_area", "id_type", "area_name",
        geo.rectangle(x1, y1, x2, y2).alias("geom"),
        geo.rectangle(*_degrees(x1, y1), *_degrees(x2, y2)).alias("geom_4326"),
    )
    return _shaped(rows, "area")


def cor_area(orders: DataFrame) -> DataFrame:
    """The mesh cell of every located observation's anchor, and the named area 5 of
    every other one: links that the mesh must leave out."""
    k = F.col("o_orderkey")
    x, y = local_position(F.col("o_custkey"), k)
    cell = (
        F.floor((y - ORIGIN_Y) / MESH_M) * MESH_COLUMNS + F.floor((x - ORIGIN_X) / MESH_M) + FIRST_CELL_ID
    )
    rows = orders.filter(k % 10 != 9).select(
        k.alias("id_synthese"),
        F.explode(F.when(k % 2 == 0, F.array(cell, F.lit(5).cast("bigint"))).otherwise(F.array(cell))).alias("id_area"),
    )
    return _shaped(rows, "cor_area")


# Columns read from the test tables.
READ = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
}


def dataset(nation: DataFrame) -> DataFrame:
    key = F.col("n_nationkey")

    def flag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}": '), F.when(value, "true").otherwise("false"))

    flags = F.concat(
        F.lit("{"), flag("to_pole_vert", key % 2 == 0), F.lit(", "),
        flag("to_pole_inv", key % 3 == 0), F.lit("}"),
    )
    rows = nation.select(
        key.alias("id_dataset"),
        F.concat(F.lit("d-"), key.cast("string")).alias("unique_dataset_id"),
        F.col("n_name").alias("dataset_name"),
        F.concat(F.lit("Dataset of "), "n_name").alias("dataset_desc"),
        F.col("n_regionkey").alias("id_acquisition_framework"),
        flags.alias("additional_data"),
    )
    return _shaped(rows, "dataset")


def framework(region: DataFrame) -> DataFrame:
    key = F.col("r_regionkey")
    rows = region.select(
        key.alias("id_acquisition_framework"),
        F.concat(F.lit("f-"), key.cast("string")).alias("unique_acquisition_framework_id"),
        F.col("r_name").alias("acquisition_framework_name"),
        F.concat(F.lit("Framework of "), "r_name").alias("acquisition_framework_desc"),
    )
    return _shaped(rows, "framework")


def taxref(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    code = F.element_at(F.array(*[F.lit(c) for c in RANK_CODES]), F.col("p_size") % 5 + 1)
    rows = part.select(
        key.alias("cd_nom"), (key - key % 3).alias("cd_ref"), code.alias("id_rang"),
        F.col("p_name").alias("lb_nom"), F.col("p_brand").alias("nom_vern"),
        F.col("p_type").alias("group2_inpn"),
    )
    return _shaped(rows, "taxref")


def tables(spark: SparkSession, folder: str) -> Tables:
    def read(name: str) -> DataFrame:
        return spark.read.schema(READ[name]).parquet(f"{folder}/{name}.parquet")

    def orders() -> DataFrame:
        return read("orders")

    def rows(table: str, values, columns: str | None = None):
        literal = lambda: _literal(spark, values, columns or SCHEMAS[table])
        return literal if columns is None else lambda: _shaped(literal(), table)

    return Tables(
        {
            "observation": lambda: observation(orders()),
            "validation": lambda: validation(orders()),
            "cor_area": lambda: cor_area(orders()),
            "area": lambda: area(spark),
            "area_type": rows("area_type", [(26, "DEP"), (27, "M5"), (28, "REG")]),
            "dataset": lambda: dataset(read("nation")),
            "framework": lambda: framework(read("region")),
            "taxref": lambda: taxref(read("part")),
            "rank": rows("rank", RANKS),
            "nomenclature": rows("nomenclature", STATUSES),
            "source": rows(
                "source", SOURCES,
                "id_source int, name_source string, desc_source string, "
                "meta_update_date string, additional_data string",
            ),
            "import": rows(
                "import", IMPORT_ROWS,
                "id_import int, date_create_import string, additional_data string",
            ),
            "invasive": rows("invasive", INVASIVE),
            "report": rows("report", REPORTS),
        }
    )
