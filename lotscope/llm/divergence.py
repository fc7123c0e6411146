"""How the sources of a language differ from one another and from the language.

Terms are counted by language and source; each language keeps the terms of enough documents.  A
source's distance to another is summed over all kept terms, and its most telling terms are ranked.

For the ranking, partitions keep skybands: of two terms, the one with the higher count in the
source, the lower in the language and the earlier name ranks before the other, so a term with as
many such others as there are ranks can't be ranked.  What the partitions keep is merged by the
same rule, and only then is it ranked exactly.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotscope.functions.sizing import broadcast_if_small
from lotscope.llm.common import checkpointed, written

#: Documents that a term must occur in, and terms ranked for a source.
LEAST_DOCS, RANKS = 10, 10
SCALE = 1_000_000_000
#: Different terms of all groups that a worker counts before it hands them on.
COUNTED = 1 << 18
#: Documents whose words are split and looked up together.
SLICE = 1000
#: Terms of one source that a worker looks at before it drops those that can't be ranked.
LOOKED_AT = 1 << 14
#: Sources that are compared as one block, and terms at a time.
BLOCK, TERMS = 32, 1 << 12
#: Counts of a language that one task compares, about.
COMPARED = 1 << 16
BROADCAST_GROUPS = 10_000

#: For ``bytes.translate``: A-Z to a-z, and blanks for what belongs to no term.
TERM_BYTES = bytes(
    ord(chr(b).lower()) if chr(b) in string.ascii_uppercase else b if chr(b) in string.ascii_lowercase or b > 127 else 32
    for b in range(256)
)


def counted(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs`` (documents with it) of
    all whole texts; every group also has a row with a null term."""
    wanted = docs.select(
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    schema = "lang string, source string, term string, n bigint, docs bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        groups: dict[tuple[str, str], list[np.ndarray]] = {}
        held = 0

        def made() -> Iterator[pa.RecordBatch]:
            names = pa.array([w.decode() for w in numbers], pa.string())
            for (lang, source), parts in groups.items():
                of = np.concatenate([np.zeros(0, np.int32), *(p[0] for p in parts)])
                times = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
                docs = np.bincount(of, minlength=1)
                here = np.flatnonzero(docs)
                n = np.bincount(of, weights=times, minlength=1)[here].astype(np.int64)
                terms = pa.concat_arrays([pa.nulls(1, pa.string()), names.take(pa.array(here))])
                same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), np.int64))) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays(
                    [*same, terms, *(pa.array(np.concatenate([[0], x])) for x in (n, docs[here]))],
                    ["lang", "source", "term", "n", "docs"],
                )
            groups.clear()
            numbers.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                names: dict[tuple[str, str], int] = {}
                of = np.array([names.setdefault(k, len(names)) for k in zip(*(c.to_pylist() for c in part.columns[:2]))], np.int64)
                # Words of all texts of the slice at once; each different word is looked up once.
                split = pc.split_pattern(pa.array([t.translate(TERM_BYTES) for t in part.column(2).to_pylist()], pa.binary()), b" ")
                words, doc = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
                real = pc.not_equal(pc.binary_length(words), 0)
                words, doc = pc.dictionary_encode(words.filter(real)), doc[real.to_numpy(zero_copy_only=False)]
                known = np.fromiter(map(numbers.__getitem__, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
                # Each term of a document once, with its occurrences there.
                pairs, times = np.unique((doc.astype(np.int64) << 32) | known[words.indices.to_numpy()], return_counts=True)
                group = of[pairs >> 32]
                order = np.argsort(group, kind="stable")
                bounds = np.searchsorted(group[order], np.arange(len(names) + 1))
                terms, times = (pairs[order] & 0xFFFFFFFF).astype(np.int32), times[order]
                for key, i in names.items():
                    groups.setdefault(key, []).append((terms[bounds[i] : bounds[i + 1]], times[bounds[i] : bounds[i + 1]]))
                held += len(pairs)
                if len(numbers) >= COUNTED or held >= 16 * COUNTED:
                    yield from made()
                    held = 0
        yield from made()

    parts = wanted.mapInArrow(run, schema)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """One and the share of a term in billionths, exactly; null where nothing is kept."""
    above = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", above, F.nullif((total + 2 * terms).cast("decimal(21,0)"), F.lit(0)))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Kept:
    """``entries``: ``lang``, ``source``, ``term``, ``n`` and ``lang_n`` of every kept term of a
    group.  ``groups``: every ``lang`` and ``source`` with ``total`` (occurrences of kept terms),
    ``lang_total``, ``terms`` (kept by the language), ``held`` (entries of the language) and
    ``sources`` (of the language)."""

    def __init__(self, docs: DataFrame):
        every = written(counted(docs))
        found = every.filter("term IS NOT NULL")
        terms = checkpointed(
            found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("in_docs"), F.count("*").alias("held"))
            .filter(F.col("in_docs") >= LEAST_DOCS).drop("in_docs")
        )
        self.entries = checkpointed(found.drop("docs").join(terms.drop("held"), ["lang", "term"]))
        names = every.select("lang", "source").distinct()
        by_lang = names.groupBy("lang").agg(F.count("*").alias("sources")).join(
            terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"), F.sum("held").alias("held")),
            "lang", "left",
        )
        by_group = self.entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        self.groups = checkpointed(names.join(by_group, ["lang", "source"], "left").join(by_lang, "lang").fillna(0))

    def shares(self, *columns: str) -> DataFrame:
        """The entries with the ``columns`` of their groups and ``p``, the share in the source."""
        of = broadcast_if_small(self.groups.select("lang", "source", "total", "terms", *columns), BROADCAST_GROUPS)
        joined = self.entries.join(of, ["lang", "source"])
        return joined.withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))


# -- the most telling terms --------------------------------------------------

def skyband(n: np.ndarray, lang_n: np.ndarray, terms: list[str], most: int = RANKS) -> list[int]:
    """Places of the terms that fewer than ``most`` others are ahead of: with as high an ``n``,
    as low a ``lang_n`` and an earlier name.  Counting those kept is enough: of the terms ahead of
    one, the first few in order are kept themselves."""
    if len(terms) <= most:
        return list(range(len(terms)))
    name = np.empty(len(terms), np.int64)
    name[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
    kept: list[int] = []
    low, early = np.empty(len(terms), np.int64), np.empty(len(terms), np.int64)
    for i in np.lexsort((name, lang_n, -n)).tolist():
        size = len(kept)
        if size >= most and np.count_nonzero((low[:size] <= lang_n[i]) & (early[:size] <= name[i])) >= most:
            continue
        low[size], early[size] = lang_n[i], name[i]
        kept.append(i)
    return kept


BAND = "lang string, source string, term string, n bigint, lang_n bigint, p bigint, q bigint"


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The skyband of each group of a partition that is sorted by group."""
    held: list[dict] = []
    limit = LOOKED_AT

    def reduced() -> list[dict]:
        n, lang_n = (np.array([r[c] for r in held], np.int64) for c in ("n", "lang_n"))
        return [held[i] for i in skyband(n, lang_n, [r["term"] for r in held])]

    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[0]["lang"], held[0]["source"]) != (row["lang"], row["source"]):
                yield pa.RecordBatch.from_pylist(reduced(), schema=batch.schema)
                held, limit = [], LOOKED_AT
            held.append(row)
            if len(held) >= limit:
                held = reduced()
                limit = LOOKED_AT + 2 * len(held)
    if held:
        yield pa.RecordBatch.from_pylist(reduced(), schema=batch.schema)


def telling_terms(kept: Kept) -> DataFrame:
    """``lang``, ``source``, ``item`` (term), ``value`` and ``rank`` of the first terms of every
    group by distance from the language, among those more common in the group."""
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    above = kept.shares("lang_total").withColumn("q", q).filter("p > q").select(*(f.split()[0] for f in BAND.split(", ")))
    local = above.sortWithinPartitions("lang", "source").mapInArrow(_bands, BAND)
    merged = local.repartition("lang", "source").sortWithinPartitions("lang", "source").mapInArrow(_bands, BAND)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        merged.select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= RANKS)
    )


# -- sources against one another ---------------------------------------------

SUMS = "lang string, a string, b string, value bigint, seen bigint, zero bigint, terms bigint"


class Block:
    """Two blocks of sources, term by term: sums of distances and the number of terms seen."""

    def __init__(self, key: tuple):
        self.key = key
        self.names: list[str] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.zeros: list[int] = []
        self.terms = self.seen = 0
        self.sums: np.ndarray | None = None

    def source(self, row: dict) -> None:
        _, low, high, _ = self.key
        at = len(self.names)
        self.names.append(row["source"])
        self.zeros.append(row["p"] or 0)
        self.terms = row["terms"]
        if row["block"] == low:
            self.left.append(at)
        if row["block"] == high:
            self.right.append(at)

    def start(self) -> None:
        self.place = {name: i for i, name in enumerate(self.names)}
        self.sums = np.zeros((len(self.left), len(self.right)), np.int64)
        self._clear()

    def _clear(self) -> None:
        self.term, self.column = None, -1
        self.rows: list[tuple[int, int, int]] = []

    def entry(self, row: dict) -> None:
        if self.sums is None:
            self.start()
        if row["term"] != self.term:
            if self.column + 1 == TERMS:
                self.add()
            self.term = row["term"]
            self.column += 1
        self.rows.append((self.place[row["source"]], self.column, row["p"]))

    def add(self) -> None:
        if not self.rows:
            return
        share = np.repeat(np.array(self.zeros, np.int64)[:, None], self.column + 1, axis=1)
        where = np.array(self.rows, np.int64)
        share[where[:, 0], where[:, 1]] = where[:, 2]
        right = share[self.right]
        for i, at in enumerate(self.left):
            gap = share[at] - right
            self.sums[i] += (gap * gap // (share[at] + right)).sum(axis=1)
        self.seen += self.column + 1
        self._clear()

    def made(self) -> list[dict]:
        if self.sums is None:
            self.start()
        self.add()
        out = []
        for i, a in enumerate(self.left):
            for j, b in enumerate(self.right):
                if a < b or self.key[1] != self.key[2]:
                    p, q = self.zeros[a], self.zeros[b]
                    zero = (p - q) ** 2 // (p + q) if p + q else 0
                    out.append({
                        "lang": self.key[0], "a": self.names[a], "b": self.names[b], "value": int(self.sums[i, j]),
                        "seen": self.seen, "zero": zero, "terms": self.terms,
                    })
        return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(f.split() for f in SUMS.split(", ")), strict=True)
    schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64()}[k]) for n, k in zip(names, kinds, strict=True)])
    block: Block | None = None
    for batch in batches:
        for row in batch.to_pylist():
            key = row["lang"], row["low"], row["high"], row["bucket"]
            if block is None or block.key != key:
                if block:
                    yield pa.RecordBatch.from_pylist(block.made(), schema=schema)
                block = Block(key)
            (block.source if row["term"] is None else block.entry)(row)
    if block:
        yield pa.RecordBatch.from_pylist(block.made(), schema=schema)


def source_distances(kept: Kept) -> DataFrame:
    """``lang``, ``source``, ``item`` (every other source of the language), ``value`` and ``rank``.

    Sources of a language are dealt into blocks.  For each two blocks and each share of the terms,
    a stream of their counts, by term, is compared as a dense matrix, some terms at a time: no
    pairs of a term's sources are ever made.  Terms that two blocks lack add the same each time.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("sources") / BLOCK)).cast("int")
    buckets = F.greatest(F.lit(1), F.ceil(2 * F.col("held") / blocks / COMPARED)).cast("int")
    own = F.pmod(F.xxhash64("source"), blocks).cast("int")
    dealt = {"block": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))}
    columns = ["lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "bucket", "block", "source", "term", "p", "terms"]
    entries = kept.shares("sources", "held").withColumns(dealt).withColumn("bucket", F.pmod(F.xxhash64("term"), buckets).cast("int"))
    zero = _share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))
    heads = kept.groups.withColumns(dealt).select(
        "*", F.explode(F.sequence(F.lit(0), buckets - 1)).alias("bucket"), F.lit(None).cast("string").alias("term"), zero.alias("p")
    )
    keys = ["lang", "low", "high", "bucket"]
    rows = entries.select(*columns).unionByName(heads.select(*columns)).repartition(*keys)
    sums = rows.sortWithinPartitions(*keys, F.asc_nulls_first("term")).mapInArrow(_sums, SUMS)
    pairs = sums.groupBy("lang", "a", "b").agg(
        (F.sum("value") + (F.max("terms") - F.sum("seen")) * F.max("zero")).alias("value")
    )
    both = F.inline(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba"))))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", both, "value").withColumn("rank", F.row_number().over(by_value))


def diverging(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value`` and ``rank`` of all
    groups of ``docs`` (text, lang, source; further columns are passed over).

    Nulls count as empty strings, repeated rows as documents each; groups without terms and
    languages that keep none have their pairs too.  An empty table has no rows.
    """
    kept = Kept(docs)
    parts = {"pair": source_distances(kept), "term": telling_terms(kept)}
    pair, term = (
        df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, df in parts.items()
    )
    return pair.unionByName(term)


def op13_source_divergence(docs: DataFrame) -> DataFrame:
    return diverging(docs)


#: The same from the definition, over all pairs and all terms.
OP13_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents
), places AS (SELECT row, lang, source, unnest(words) AS term FROM texts),
kept AS (
    SELECT lang, term, count(*) AS n FROM places GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), counts AS (
    SELECT p.lang, source, p.term, count(*) AS n FROM places p JOIN kept k ON p.lang = k.lang AND p.term = k.term GROUP BY ALL
), langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (
    SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(sum(c.n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM texts) g LEFT JOIN langs l ON g.lang = l.lang
        LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source
    GROUP BY g.lang, g.source, v
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
    FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
        LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums s ON a.lang = s.lang AND a.source = s.source AND b.source = s.item
    UNION ALL
    SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""
