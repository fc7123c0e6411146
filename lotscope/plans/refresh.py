"""Storing the marts: all of them or none."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotscope.operators.marts import LOT, MARTS
from lotscope.workspace import Workspace, with_months

ROLLUP = "rollup"
_PUBLISHED = "published"


def rollup(ws: Workspace) -> DataFrame:
    """Observations counted by every key that the count marts use.  One scan of the
    facts serves five marts."""
    return (
        with_months(ws.observation)
        .groupBy(*LOT, "id_dataset", "cd_nom", "annee", "mois")
        .agg(F.count(F.lit(1)).alias("nb_data"))
    )


def refresh_marts(ws: Workspace, root: str, version: str | None = None) -> str:
    """Write the rollup, then every mart, under a new version; publish the version once
    all are written.  A failure leaves the published version as it was, since readers
    follow the publication record."""
    spark = ws.tables.observation.sparkSession
    version = version or time.strftime("%Y%m%dT%H%M%S") + f"-{time.time_ns() % 10**9:09d}"
    base = f"{root}/version={version}"
    rollup(ws).write.parquet(f"{base}/{ROLLUP}")
    stored = Workspace(
        ws.tables, ws.params, rollup=spark.read.parquet(f"{base}/{ROLLUP}")
    )
    for name, build in MARTS.items():
        build(stored).write.parquet(f"{base}/{name}")
    record = spark.createDataFrame(
        [(version, time.time_ns())], "version string, published_at bigint"
    )
    record.coalesce(1).write.mode("append").parquet(f"{root}/{_PUBLISHED}")
    return version


def published_version(spark: SparkSession, root: str) -> str:
    latest = spark.read.schema("version string, published_at bigint").parquet(f"{root}/{_PUBLISHED}")
    return latest.agg(F.max_by("version", "published_at")).first()[0]


def with_stored_marts(ws: Workspace, root: str) -> Workspace:
    """The workspace reading the published marts instead of computing them."""
    spark = ws.tables.observation.sparkSession
    base = f"{root}/version={published_version(spark, root)}"
    return Workspace(
        ws.tables,
        ws.params,
        marts={name: spark.read.parquet(f"{base}/{name}") for name in MARTS},
        rollup=spark.read.parquet(f"{base}/{ROLLUP}"),
    )
