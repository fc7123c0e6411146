"""Intermediate results that are worked out once and kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder that the session names in
    ``spark.checkpoint.dir``, and read back: worked out once, where a checkpoint runs its last
    stage twice and is not compressed.  Only a local session may name none: executors of a cluster
    do not see the driver's folders."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    path = f"{context.getCheckpointDir()}/stored-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
