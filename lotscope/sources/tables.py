"""Reading and preparing the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotscope.functions import text
from lotscope.model import SCHEMAS, Tables, struct_type


def read_parquet(spark: SparkSession, root: str) -> Tables:
    """All tables under ``root``, one folder or file each, with declared schemas.  A
    stored ``lot_id`` of the observations is read along."""

    def reader(name: str):
        def read() -> DataFrame:
            schema, path = struct_type(name), f"{root}/{name}.parquet"
            if name == "observation" and "lot_id" in spark.read.parquet(path).columns:
                schema = schema.add("lot_id", "string")
            return spark.read.schema(schema).parquet(path)

        return read

    return Tables({name: reader(name) for name in SCHEMAS})


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """A database query as a DataFrame; given a numeric column and its range, it is
    read by that many connections at once."""
    reader = spark.read.format("jdbc").options(**jdbc_options(url, query, split_on, bounds, partitions))
    return reader.options(**(options or {})).load()


def jdbc_options(
    url: str,
    query: str,
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
) -> dict[str, str]:
    base = {"url": url, "dbtable": f"({query}) AS q", "fetchsize": "10000"}
    if split_on is None:
        return base
    if bounds is None:
        raise ValueError("a split column needs its bounds")
    return base | {
        "partitionColumn": split_on,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(partitions),
    }


def write_prepared(tables: Tables, root: str) -> None:
    """Store the tables for repeated use.

    Observations get their ``lot_id`` and are laid out by lot, then identifier: a
    filter on lots then skips files and row groups by their statistics, and a large
    lot still spreads over as many files as it needs.
    """
    for name, df in tables.items():
        if name == "observation":
            df = (
                df.withColumn("lot_id", text.lot_id(F.col("id_source"), F.col("id_import")))
                .repartitionByRange("lot_id", "id_synthese")
                .sortWithinPartitions("lot_id", "id_synthese")
            )
        df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")
