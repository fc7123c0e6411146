"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.llm.common import checkpointed


def _signature(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) of every node that has an edge to
    another one.  ``edges`` has the bigint columns ``a`` and ``b``; self-edges, repeated
    edges and edges with a null change nothing.

    Each round hangs every larger neighbour of a node on the node's smallest neighbour and
    then every smaller neighbour on the smallest.  Rounds grow with the logarithm of the
    size; nothing but a count and two checksums reaches the driver.
    """
    now = checkpointed(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = _signature(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.unionByName(smallest.withColumnRenamed("m", "v")).distinct())
        before, seen = seen, _signature(now)
        if before == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
