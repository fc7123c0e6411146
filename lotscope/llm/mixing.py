"""Mixing sources to target sizes by thresholds on a hash, found from histograms.

A document is in the mix if its hash is below its source's threshold.  A histogram of the
sizes by source and the first bits of the hash shows in which bucket each threshold lies; only
that bucket is looked at more closely, by the next bits.  Nothing is sorted or drawn at random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotscope.functions.sizing import broadcast_if_small
from lotscope.llm.common import checkpointed, word_count

WEIGHTS = (5, 2, 1)
#: Size of the mix, as a share of all sizes, and the most that a source is repeated.
SHARE, MOST = 1.5, 2
#: Bits of the hash, and of each step of the search.
BITS, STEP = 60, 12
#: Sources up to which what is known of each is broadcast.
BROADCAST_SOURCES = 100_000


def hashed(doc_id: Column, text: Column) -> Column:
    """60 bits that depend on nothing but the row: the first 15 hex digits of an MD5."""
    known = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(known.cast("binary")), 1, 15), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (distinct ``source``) with ``rank``, from 0, by code point, null last.

    Sorted in ranges; the rank is the position in the range plus the lengths of those before.
    """
    placed = checkpointed(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id())
    )
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    position = F.col("_at").bitwiseAND((1 << 33) - 1)
    return (
        placed.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(ranges), "_range")
        .withColumn("rank", F.col("_before") + position).drop("_at", "_range", "_n", "_before")
    )


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, ``source_size``, ``target`` of ``sizes`` (source, source_size).

    The weights go round over the ranked sources.  All targets are the weight times one level,
    but at most ``most`` times the source's size; what those sources can't take raises the
    level of the others.  The level settles as each round fixes the sources that it fills.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    known = checkpointed(ranked(sizes).select("source", "source_size", weight.cast("double").alias("weight")))
    cap = F.col("source_size") * most
    total = (known.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        filled = cap < F.col("weight") * level
        n, taken, left = known.agg(
            F.count(F.when(filled, 1)), F.sum(F.when(filled, cap)), F.sum(F.when(~filled, F.col("weight")))
        ).first()
        if n == full or not left:
            break
        full, level = n, (total - (taken or 0)) / left
    return known.select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * level).alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame, copies: int = MOST) -> DataFrame:
    """``source``, ``copy`` (1 to ``copies``) and ``below``: a row is taken a ``copy``-th time
    if its ``hash`` is below.  ``rows`` has source, size, hash; ``wanted`` source,
    source_size, target.  The thresholds of the copies are nested, the first the highest.

    Rows of one hash are decided together, by what comes nearer to the target.
    """
    budgets = wanted.select(
        "source", "source_size", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"), "target"
    ).select(
        "source", "copy", F.least(F.col("target") - (F.col("copy") - 1) * F.col("source_size"), "source_size").alias("rest"), "source_size"
    )
    whole = F.col("rest") >= F.col("source_size")
    decided = budgets.filter(whole | (F.col("rest") <= 0)).select(
        "source", "copy", F.when(whole, F.lit(1 << BITS)).otherwise(F.lit(0)).cast("long").alias("below")
    )
    open_ = checkpointed(
        budgets.filter(~whole & (F.col("rest") > 0)).select("source", "copy", "rest", F.lit(0).cast("long").alias("prefix"))
    )
    for used in range(0, BITS, STEP):
        inside = rows.alias("r").join(
            broadcast_if_small(open_.select("source", "copy", "rest", "prefix"), BROADCAST_SOURCES).alias("o"),
            F.col("r.source").eqNullSafe(F.col("o.source")) & (F.shiftright("r.hash", BITS - used) == F.col("o.prefix")),
        )
        shift = BITS - used - STEP
        histogram = inside.groupBy("o.source", "copy", "rest", F.shiftright("r.hash", shift).alias("prefix")).agg(
            F.sum("size").alias("size"), F.count("*").alias("n")
        )
        upto = Window.partitionBy("source", "copy").orderBy("prefix")
        found = histogram.withColumn("upto", F.sum("size").over(upto)).filter(
            (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("size") <= F.col("rest"))
        )
        open_ = checkpointed(
            found.select("source", "copy", "prefix", "size", "n", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"))
        )
        if not open_.filter("n > 1").limit(1).count():
            break
    edge = F.when(F.col("rest") * 2 >= F.col("size"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    return decided.unionByName(open_.select("source", "copy", F.call_function("shiftleft", edge, F.lit(shift)).alias("below")))


def mixed(docs: DataFrame, *extra: str) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source) as ``doc_id``, ``size`` (words),
    ``source_size``, ``target`` and ``copies`` (0 to 2), with the columns ``extra``.

    A null text has the size 0 and is taken or not by its hash like others.  Null sources are
    one source, the last.  Repeated rows have one hash and are taken or left together.
    """
    row = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hashed(F.col("doc_id"), F.col("text")).alias("hash"), *extra)
    narrow = checkpointed(row.select("doc_id", "source", "size", "hash")) if not extra else None
    rows = narrow if narrow is not None else checkpointed(row.select("source", "size", "hash"))
    wanted = checkpointed(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    found = thresholds(rows, wanted)
    below = [F.max(F.when(F.col("copy") == c, F.col("below"))).alias(f"below_{c}") for c in range(1, MOST + 1)]
    plan = wanted.alias("w").join(
        found.groupBy("source").agg(*below).alias("b"), F.col("w.source").eqNullSafe(F.col("b.source")), "left"
    ).select("w.*", *(f"b.below_{c}" for c in range(1, MOST + 1)))
    copies = sum((F.col("hash") < F.coalesce(f"below_{c}", F.lit(0))).cast("int") for c in range(1, MOST + 1))
    taken = row if narrow is None else narrow
    joined = taken.alias("r").join(broadcast_if_small(plan, BROADCAST_SOURCES).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    return joined.select("r.*", "source_size", "target", copies.alias("copies")).drop("hash")


def op8_hash_mixing(docs: DataFrame) -> DataFrame:
    return mixed(docs).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken")
    )


#: The same by a running sum over all rows of a source in hash order.
OP8_SQL = r"""
WITH sized AS (
    SELECT doc_id, source,
        CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
    FROM documents
), totals AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
    FROM sized GROUP BY source
), levels AS (
    SELECT *, 2.0::DOUBLE * source_size / weight AS full_at,
        (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER by_full_before, 0)) / sum(weight) OVER by_full_after AS level
    FROM totals
    WINDOW by_full_before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        by_full_after AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), aimed AS (
    SELECT source, source_size,
        least(2.0::DOUBLE * source_size, weight * (SELECT first(level ORDER BY full_at, source) FROM levels WHERE level <= full_at)) AS target
    FROM levels
), summed AS (
    SELECT s.*, source_size, target, sum(size) OVER (PARTITION BY s.source ORDER BY hash) AS upto,
        sum(size) OVER (PARTITION BY s.source, hash) AS here
    FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
), copied AS (
    SELECT *, CASE WHEN target >= source_size THEN 1 WHEN target <= 0 THEN 0 WHEN upto <= target THEN 1
            WHEN upto - here <= target AND (target - upto + here) * 2 >= here THEN 1 ELSE 0 END
        + CASE WHEN target - source_size >= source_size THEN 1 WHEN target - source_size <= 0 THEN 0
            WHEN upto <= target - source_size THEN 1
            WHEN upto - here <= target - source_size AND (target - source_size - upto + here) * 2 >= here THEN 1 ELSE 0 END AS copies
    FROM summed
)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(copies * size AS BIGINT) AS taken FROM copied
"""
