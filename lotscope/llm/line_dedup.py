"""Repeated runs of lines, found by winnowing over line hashes with built-in functions only.

A window is the shortest run of whole lines that begins (or ends) at a given line and holds at
least ``MIN_WORDS`` words.  Its smallest line hash, the rightmost of equal ones, is its
fingerprint.  Two copies of a run with that many words contain the same windows and so the same
fingerprints.  Only windows whose fingerprint occurs at several positions go on; these are
grouped by 96 bits of hash over all of their lines, and the first of each group stays.  Matches
are not extended from pairs of positions, whose number may grow with the square of the copies:
the windows that begin at a line and those that end at one together cover a repeated run to its
last line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotscope.llm.common import checkpointed, word_count

MIN_WORDS = 50
DOC = ("doc_id", "content")


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``content``, ``line`` (from 0), ``hash``, ``words`` and the running ``upto``
    of every line with words.  Repeated rows count once."""
    # Rows of one doc_id with different texts are told apart by a hash.
    made = docs.select("doc_id", "text", F.xxhash64("text").alias("content")).select(*DOC, F.posexplode(F.split("text", "\n")).alias("line", "text"))
    counted = made.select(*DOC, "line", F.xxhash64("text").alias("hash"), word_count(F.col("text")).alias("words")).filter("words > 0")
    distinct = counted.repartition(*DOC).groupBy(*DOC, "line").agg(F.first("hash").alias("hash"), F.first("words").alias("words"))
    before = Window.partitionBy(*DOC).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return distinct.withColumn("upto", F.sum("words").over(before))


def windows(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Of every line, the window that begins and the window that ends there, if there are so
    many words: ``first`` and ``last`` line, ``anchor`` (the fingerprint) with its ``place``,
    and two hashes of all lines.

    A line is in the window from line i if it starts less than ``min_words`` words after i
    does, and in the window to line i if it ends less than so many words before i does.
    """
    start = F.col("upto") - F.col("words")
    of = Window.partitionBy(*DOC)
    ahead = of.orderBy("start").rangeBetween(0, min_words - 1)
    behind = of.orderBy("upto").rangeBetween(-(min_words - 1), 0)
    found = found.withColumn("start", start)

    least = F.min(F.struct("hash", (-F.col("line")).alias("back")))
    found = found.select(*DOC, *(
        c.over(over).alias(f"{side}_{name}")
        for side, over in (("ahead", ahead), ("behind", behind))
        for name, c in (
            ("first", F.min("line")), ("last", F.max("line")), ("least", least), ("every", F.collect_list("hash")),
            ("start", F.min("start")), ("end", F.max("upto")),
        )
    ))

    def window(side: str) -> Column:
        of = lambda name: F.col(f"{side}_{name}")
        return F.struct(
            of("first").alias("first"), of("last").alias("last"), of("least")["hash"].alias("anchor"),
            (-of("least")["back"]).alias("place"), F.xxhash64(of("every")).alias("run"), F.hash(of("every")).alias("run2"),
            (of("end") - of("start")).alias("words"),
        )

    both = found.select(*DOC, F.explode(F.array(window("ahead"), window("behind"))).alias("w"))
    return both.select(*DOC, "w.*").filter(F.col("words") >= min_words).drop("words")


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``content``, ``first``, ``last``: the windows whose lines occurred before, in
    the order of doc_id, content and line.  Lines that also belong to the first occurrence,
    which it overlaps in a document of one repeated line, are left out."""
    every = windows(lines(docs), min_words)
    position = F.xxhash64(*DOC, "place")
    shared = every.groupBy("anchor").agg(F.min(position).alias("a"), F.max(position).alias("b")).filter("a <> b")
    # Written first, so that the joins are plain ones, whose hot keys Spark splits.
    live = checkpointed(every.join(checkpointed(shared.select("anchor")), "anchor", "left_semi"))
    runs = live.groupBy("run", "run2").agg(
        F.min(F.struct(*DOC, "first", "last")).alias("origin"), F.count("*").alias("n")
    ).filter("n > 1").drop("n")
    runs = checkpointed(runs)
    same = F.col("doc_id").eqNullSafe(F.col("origin.doc_id")) & (F.col("content") == F.col("origin.content"))
    begin = F.when(same, F.greatest("first", F.col("origin.last") + 1)).otherwise(F.col("first"))
    return live.join(runs, ["run", "run2"]).select(*DOC, begin.alias("first"), "last").filter("first <= last")


def removals(found: DataFrame) -> DataFrame:
    """The ranges of ``repeated`` joined per document: ``removed``, an ascending array of
    struct<first, last> without overlaps.  Bounded by the lines of a document."""
    order = Window.partitionBy(*DOC).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("first") > reach + 1).cast("int"), F.lit(1))
    numbered = found.distinct().withColumn("begins", begins).withColumn("part", F.sum("begins").over(order))
    joined = numbered.groupBy(*DOC, "part").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return joined.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("removed"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text) with the lines of later repeated runs deleted from ``text``, and
    ``removed`` (the ranges of line numbers), ``n_lines``, ``n_removed``.

    A run is repeated if consecutive lines with at least ``min_words`` words in all are the
    same as lines earlier in the table, by hashes of the whole lines (64 bits a line, 96 a
    window).  All lines of one document are put in order in one task.  Lines without words are
    passed over, and go where they stand inside a deleted run.  A null text stays null; a text
    that loses all lines becomes empty.  Repeated rows with one doc_id and text are one
    document and stay alike; other columns stay as they are, but for those of the names above,
    which are replaced.
    """
    ranges = removals(repeated(docs, min_words)).select(
        F.col("doc_id").alias("_run_doc"), F.col("content").alias("_run_content"), F.col("removed").alias("_run_removed")
    )
    same = docs["doc_id"].eqNullSafe(ranges["_run_doc"]) & (F.xxhash64(docs["text"]) == ranges["_run_content"])
    split = docs.join(ranges, same, "left").withColumn("_run_lines", F.split("text", "\n"))
    removed, whole = F.col("_run_removed"), F.size("_run_lines")
    starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda r: r["last"] + 1))
    ends = F.concat(F.transform(removed, lambda r: r["first"]), F.array(whole))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(F.col("_run_lines"), a + 1, b - a)))
    gone = F.aggregate(removed, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return split.withColumns({
        "text": F.when(removed.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.greatest(whole, F.lit(0)).cast("long"),
        "n_removed": F.coalesce(gone, F.lit(0)).cast("long"),
        "removed": removed,
    }).drop("_run_doc", "_run_content", "_run_removed", "_run_lines")


def op4_line_winnowing(docs: DataFrame) -> DataFrame:
    """The whole cleaned texts, with the ranges removed as ``first-last``, comma-joined."""
    made = deduplicated(docs.select("doc_id", "text"))
    shown = F.transform("removed", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string")))
    return made.select("doc_id", "text", "n_lines", "n_removed", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("removed"))
