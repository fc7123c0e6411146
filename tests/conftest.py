from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ws(spark):
    from lotscope import Workspace
    from lotscope.sources import orders

    return Workspace(orders.tables(spark, SMALL), orders.TEST_PARAMS)


@pytest.fixture(scope="session")
def make(spark):
    """A workspace from rows of chosen tables; the other tables are empty."""
    from pyspark.sql import functions as F

    from lotscope import Params, Tables, Workspace
    from lotscope.model import SCHEMAS, struct_type

    def build(params: dict | None = None, **frames):
        made = {}
        for name in SCHEMAS:
            given = frames.get(name)
            full = struct_type(name)
            if given is None:
                made[name] = spark.createDataFrame([], full)
                continue
            missing = [f for f in full.fields if f.name not in given.columns]
            made[name] = given.select(
                "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]
            ).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in full.fields])
        return Workspace(Tables.of(made), Params(**(params or {})))

    return build
