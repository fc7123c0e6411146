"""What filters on documents remove, in every order of applying them.

Words are counted in a sparse matrix of documents and terms.  Each batch of documents is a shard
with its own list of words, in compressed rows.  All lists together make one dictionary, which
gives a word its hash as its number once no two words of the corpus are found to share one, and
else the place where it lies; the shards' columns are numbered by it.  A task holds a few shards
at a time, however many it reads: a shard is a row, and rows lie in small groups.  Sums and numbers of entries of the rows decide on A
(too few words) and B (too few distinct ones).  C (capitals), D (marks) and E (copies) are told
of the text itself, and all that is left is counted by part and by which filters fail: 32 numbers
from which every order follows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.llm.common import ROWS, checkpointed, written

LETTERS = "ABCDE"
#: Fewest words, and distinct words and capitals as hundredths of words and code points.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
MARKS = "[#$%&*|]"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
#: Bytes of text at which a shard ends, with a document.
SHARD_BYTES = 512 << 10
#: Shards in a row group of the written matrix: so many are in memory where it is written or read.
GROUP = 16
#: Shards that one partition may number.
NUMBERS = 1 << 32

SHARDS = (
    "shard bigint, words array<binary>, starts array<int>, columns array<int>, counts array<int>, "
    "docs array<struct<doc_id:bigint,part:string,digest:binary,marked:int>>"
)
NUMBERED = "doc_id bigint, part string, digest binary, mask int"


class Shard:
    """A batch of documents in compressed rows, its words numbered as they come."""

    def __init__(self):
        # By a counter: a dictionary that asks itself would stay until Python looks for cycles.
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.docs: list[dict] = []
        self.columns: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: dict, text: bytes) -> None:
        words = text.split()
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        columns, counts = np.unique(at, return_counts=True)
        self.docs.append(doc)
        self.columns.append(columns)
        self.counts.append(counts.astype(np.int32))
        self.size += len(text)

    def row(self, number: int) -> list:
        starts = np.concatenate([[0], np.cumsum([len(c) for c in self.columns])]).astype(np.int32)
        return [number, list(self.numbers), starts, np.concatenate(self.columns), np.concatenate(self.counts), self.docs]


def shards(docs: DataFrame) -> DataFrame:
    """The matrix of ``docs`` (doc_id, text, source) by shard: ``words`` (its columns), ``starts``,
    ``columns`` and ``counts`` of the rows, and of each row its ``doc_id``, ``part``, a ``digest``
    of the text and ``marked``: C as 4 and D as 8."""
    text = F.coalesce("text", F.lit(""))
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text)
    wanted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        (capitals.cast("int") * 4 + text.rlike(MARKS).cast("int") * 8).alias("marked"), text.cast("binary").alias("text"),
    )
    fields = docs.sparkSession.createDataFrame([], SHARDS).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(fields)
        number, shard = TaskContext.get().partitionId() * NUMBERS, Shard()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(shard.row(number), schema, strict=True)], schema=schema)

        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                for doc in batch.slice(first, ROWS).to_pylist():
                    shard.add(doc, doc.pop("text"))
                    if shard.size >= SHARD_BYTES or len(shard.docs) >= ROWS:
                        yield made()
                        number, shard = number + 1, Shard()
        if shard.docs:
            yield made()

    return wanted.mapInArrow(run, fields)


def _hashed(word):
    return F.xxhash64(word)


def clashes(own: DataFrame) -> DataFrame:
    """The ``hash`` of which ``own`` (word) has several words.  Words are told apart as keys, which
    are hashed where they lie: the least and largest word of a hash would be found by sorting all."""
    distinct = own.select(_hashed(F.col("word")).alias("hash"), "word").distinct()
    return distinct.groupBy("hash").agg(F.count("*").alias("words")).filter("words > 1").select("hash")


def matrix(docs: DataFrame) -> DataFrame:
    """The shards with ``terms``: for each of a shard's words its number in the dictionary of
    the whole corpus, so that ``terms[columns]`` are the columns of the one large matrix."""
    made = written(shards(docs), **{"parquet.block.row.count.limit": str(GROUP)})
    own = made.select("shard", F.posexplode("words").alias("column", "word"))
    if not clashes(own).limit(1).count():
        return made.withColumn("terms", F.transform("words", _hashed)).drop("words")
    # Numbered in a range for each partition of one written table.
    terms = written(own.select("word").distinct()).withColumn("term", F.monotonically_increasing_id())
    numbered = own.join(written(terms), "word").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("column", "term"))).alias("terms"))
    return made.drop("words").join(numbered.withColumn("terms", F.col("terms.term")), "shard", "left")


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A and B of each row of the matrix, added to what is known of its text."""
    for batch in batches:
        for i in range(batch.num_rows):
            part = {c: batch.column(c)[i].values for c in ("docs", "starts", "columns", "counts", "terms")}
            starts, columns, counts = (part[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("starts", "columns", "counts"))
            terms = np.zeros(0, np.int64) if part["terms"] is None else part["terms"].to_numpy(zero_copy_only=False)
            words, distinct = sparse_rows(starts, terms[columns], counts)
            mask = (words < LEAST_WORDS) + 2 * (100 * distinct < LEAST_DISTINCT * words)
            doc_id, name, digest, marked = part["docs"].flatten()
            yield pa.RecordBatch.from_arrays(
                [doc_id, name, digest, pa.array((mask + marked.to_numpy()).astype(np.int32))], ["doc_id", "part", "digest", "mask"]
            )


def sparse_rows(starts: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of entries of each row of a matrix in compressed rows."""
    if (counts <= 0).any() or len(terms) != len(counts):
        raise ValueError("every entry of a shard has a term and a count")
    totals = np.concatenate([[0], np.cumsum(counts)])
    return totals[starts[1:]] - totals[starts[:-1]], np.diff(starts)


def failures(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source) as ``doc_id``, ``part`` and ``mask``: the
    filters that it fails, A as 1 to E as 16.

    A null text is an empty one, a null source the part ''.  A row without doc_id is no copy,
    nor are others copies of it; rows that share doc_id and text are not copies of one another.
    Further columns are passed over.
    """
    known = checkpointed(matrix(docs).mapInArrow(_decided, NUMBERED))
    first = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    # Written first, so that the join shuffles both sides and splits the rows of a hot text.
    first = checkpointed(first.select("digest", "first"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return known.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + 16 * copy.cast("int")).alias("mask"))


def audited(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """For every part, order of the filters and step: ``kept``, ``removed``, ``redundant``,
    ``unique_fails``, ``good_lost``, ``toxic_lost`` and ``shapley``.

    ``labels`` (doc_id, quality, toxic) may lack documents and repeat them: one label is enough.
    """
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    marks = checkpointed(labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic")))
    rows = failed.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    counted = rows.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        *(F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c) for c in ("quality", "toxic")),
    )
    every, masks = range(1 << len(LETTERS)), F.col("mask")

    def kept(column: str):
        """For each set of filters, what all of them together keep."""
        return F.array(*(F.sum(F.when(masks.bitwiseAND(F.lit(s)) == 0, F.col(column)).otherwise(0)) for s in every))

    def by_filter(count):
        return F.array(*(F.sum(F.when(masks.bitwiseAND(F.lit(1 << i)) != 0, count).otherwise(0)) for i in range(len(LETTERS))))

    # A document that fails m filters is removed by each of them in one of m orders.
    failed_here = F.bit_count(masks)
    share = F.col("n") * F.expr(f"{len(ORDERS)} div greatest(bit_count(mask), 1)")
    by_part = counted.groupBy("part").agg(
        kept("n").alias("n"), kept("quality").alias("good"), kept("toxic").alias("toxic"),
        by_filter(F.when(failed_here == 1, F.col("n")).otherwise(0)).alias("alone"), by_filter(share).alias("shares"),
    )
    order, step = F.col("filter_order"), F.col("step")
    steps = by_part.select("*", F.explode(F.lit(ORDERS)).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step")
    )
    earlier = F.substring(order, F.lit(1), step - 1)
    before = sum(F.when(F.contains(earlier, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(LETTERS))
    here = F.instr(F.lit(LETTERS), F.substring(order, step, F.lit(1))) - 1
    bit = F.call_function("shiftleft", F.lit(1), here)
    placed = steps.withColumns({"before": before, "here": here, "bit": bit})
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("before") + F.col("bit"))
    removed = lost("n")
    return placed.select(
        "part", "filter_order", "step", F.get("n", F.col("before") + F.col("bit")).alias("kept"), removed.alias("removed"),
        (F.get("n", F.lit(0)) - F.get("n", F.col("bit")) - removed).alias("redundant"),
        F.get("alone", F.col("here")).alias("unique_fails"), lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"), F.get("shares", F.col("here")).alias("shapley"),
    )


def op12_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audited(failures(docs), labels)


#: The same from the definition, with a row for each document, order and step.
OP12_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), tested AS (
    SELECT doc_id, part, len(words) < 50 AS A, 100 * len(list_distinct(words)) < 65 * len(words) AS B,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS C,
        regexp_matches(text, '[#$%&*|]') AS D,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS E
    FROM texts
), marks AS (
    SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
    FROM labels GROUP BY doc_id
), fails AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        [x FOR x IN [CASE WHEN A THEN 'A' END, CASE WHEN B THEN 'B' END, CASE WHEN C THEN 'C' END, CASE WHEN D THEN 'D' END, CASE WHEN E THEN 'E' END] IF x IS NOT NULL] AS failed
    FROM tested LEFT JOIN marks USING (doc_id)
), kinds AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
placed AS (
    SELECT k.*, filter_order, step, filter_order[step] AS here,
        list_has_any(failed, string_split(filter_order[1 : step - 1], '')) AND step > 1 AS gone,
        list_contains(failed, filter_order[step]) AS bad
    FROM kinds k, steps
), removals AS (
    SELECT part, filter_order, step, here,
        CAST(sum(n) FILTER (NOT gone AND NOT bad) AS BIGINT) AS kept, CAST(sum(n) FILTER (NOT gone AND bad) AS BIGINT) AS removed,
        CAST(sum(n) FILTER (gone AND bad) AS BIGINT) AS redundant,
        CAST(sum(n) FILTER (bad AND len(failed) = 1) AS BIGINT) AS unique_fails,
        CAST(sum(n_good) FILTER (NOT gone AND bad) AS BIGINT) AS good_lost, CAST(sum(n_toxic) FILTER (NOT gone AND bad) AS BIGINT) AS toxic_lost
    FROM placed GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
    coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
    CAST(coalesce(sum(removed) OVER (PARTITION BY part, here), 0) AS BIGINT) AS shapley
FROM removals
"""
