"""What the text operators share: checkpoints, byte tables and the sample tables."""

from __future__ import annotations

import string
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For ``bytes.translate``: A-Z to a-z and nothing else, so other letters stay as they are.
LOWER_ASCII = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())

#: Rows that a Python function is given at once.
ROWS = 2000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, which the driver and all
    executors share.  Only a local session that names none (tests, a laptop) gets a temporary
    one: on a cluster, executors would not see it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet, and read back: for wide or large
    tables, since checkpoints are not compressed.  ``options`` are the writer's."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_with(df: DataFrame, columns: dict[str, str], schema: str, rows: Callable[..., list]) -> DataFrame:
    """Rows of ``schema`` from the batches of ``columns`` (name to SQL expression).

    ``rows`` gets one list for each column and returns one list for each field, all of
    one length: as many rows as came, or any other number.  Batches flow one by one, at
    most ``ROWS`` rows at a time.
    """
    wanted = df.select(*(F.expr(e).alias(c) for c, e in columns.items()))
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(fields)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                made = rows(*(c.to_pylist() for c in batch.slice(at, ROWS).columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, type=f.type) for values, f in zip(made, out, strict=True)], schema=out
                )

    return wanted.mapInArrow(run, fields)


def kept_by_worker(key, make: Callable):
    """``make()``, kept by the worker process for its next tasks.  For tables of bounded size
    that only save work: a new worker makes its own."""
    held = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def word_count(text: Column) -> Column:
    """Number of maximal runs without blanks (x20, x09 to x0D); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
