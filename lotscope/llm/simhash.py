"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

Two 64-bit fingerprints with at most two differing bits are cut into three segments.  The
errors fall on the segments as (2, 0, 0) or (1, 1, 0) in some order, so for one of the three
pairs (first and second, second and third, third and first) the first of the pair is free of
errors and the other has at most one.  A key is therefore the exact bits of one segment and
the index of a codeword of the perfect (23, 12) Golay code near the following segment.  A
vector lies within 3 bits of exactly one codeword, its home; one bit away from it, that home
is at most 4 bits off.  So each segment is given its home and the codewords 4 bits away (none
or five), and of two segments one bit apart, the home of one is among the keys of the other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.llm.common import LOWER_ASCII, checkpointed, rows_with
from lotscope.llm.graph import components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Lowest bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code (fixed value).
GENERATOR = 0b110001110101
#: Members of a key up to which its fingerprints are compared with one another; beyond,
#: they are linked exactly through the values one bit away from them.
COMPARED = 64
BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; 0 without words."""
    words = (text or b"").translate(LOWER_ASCII).split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    count, ones = len(words) - size + 1, np.zeros(64, np.int64)
    for at in range(0, count, BLOCK):
        hashes = np.array(
            [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(at, min(at + BLOCK, count))],
            "<u8",
        )
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the bigint ``fp`` of every row of ``docs``."""
    return rows_with(
        docs,
        {"doc_id": "doc_id", "text": "cast(text as binary)"},
        "doc_id bigint, fp bigint",
        lambda ids, texts: [ids, [fingerprint(t) for t in texts]],
    )


def _remainder(value: int) -> int:
    """Of a polynomial over GF(2), given as bits, after division by the generator."""
    for bit in range(22, 10, -1):
        if value >> bit & 1:
            value ^= GENERATOR << bit - 11
    return value


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of at most three bits, and up to five of exactly four (-1: none)."""
    syndrome = [_remainder(1 << i) for i in range(23)]
    near, far = np.zeros(2048, np.int64), [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error, at = sum(1 << b for b in bits), 0
            for b in bits:
                at ^= syndrome[b]
            if weight < 4:
                near[at] = error
            else:
                far[at].append(error)
    return near, np.array([f + [-1] * (5 - len(f)) for f in far], np.int64)


NEAR, FAR = _golay_tables()


def codewords(segment: np.ndarray) -> np.ndarray:
    """For each segment of at most 23 bits, six columns: the index of its home, and of the
    codewords four bits away (-1: none)."""
    at = np.zeros(len(segment), np.int64)
    for bit in range(23):
        at ^= np.where(segment >> bit & 1, _remainder(1 << bit), 0)
    others = np.where(FAR[at] < 0, -1, (segment[:, None] ^ FAR[at]) >> 11)
    return np.column_stack([(segment ^ NEAR[at]) >> 11, others])


def _keys(batches):
    for batch in batches:
        fp = batch["fp"].to_numpy()
        cut = [(fp >> low) & ((1 << size) - 1) for low, size in SEGMENTS]
        for pair, exact in enumerate(cut):
            index = codewords(cut[(pair + 1) % len(cut)])
            row, column = np.nonzero(index >= 0)
            key = (exact[row] << 14) | (index[row, column] << 2) | pair
            yield pd.DataFrame({"key": key, "fp": fp[row], "home": column == 0})


def _around(fp: Column) -> Column:
    """The value itself and the 64 values one bit away."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(64)),
        lambda i: F.when(i == 64, fp).otherwise(fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))),
    )


def links(values: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` that join all fingerprints of ``values`` (distinct ``fp``) with at
    most two differing bits into the same components.

    Every edge is verified.  Keys of up to ``COMPARED`` members compare them; a key with more
    doesn't list its pairs: two values differ in at most two bits exactly if they share one
    of the 65 values at most one bit away from each, and each of those keeps a star.
    """
    keys = values.mapInPandas(_keys, "key bigint, fp bigint, home boolean")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("any")).filter("n > 1 and any")
    live = checkpointed(keys.join(shared.select("key", "n"), "key"))
    small = live.filter(F.col("n") <= COMPARED)
    pairs = (
        small.filter("home").select("key", F.col("fp").alias("a"))
        .join(small.select("key", F.col("fp").alias("b")), "key")
        .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    near = (
        live.filter(F.col("n") > COMPARED).select("fp").distinct()
        .select("fp", F.explode(_around(F.col("fp"))).alias("between"))
    )
    stars = near.groupBy("between").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return pairs.unionByName(near.join(stars, "between").filter("fp <> b").select(F.col("fp").alias("a"), "b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the smallest doc_id linked to it, directly or
    through others) of every row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text has the fingerprint 0, which links like any other.  Repeated rows
    give repeated result rows.  A null doc_id links too but is never a component's id, which
    is null only where all of its rows have none.  No rows give no rows.
    """
    found = checkpointed(fingerprints(docs))
    first = checkpointed(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(first.select("fp")))
    linked = first.join(roots, first["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.join(linked.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's smallest, each id once.

    Rows without a doc_id stay only where their component has no id at all, and then one of
    them.  Columns stay as they are.
    """
    kept = near_duplicates(docs).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi").dropDuplicates(["doc_id"])


def op6_simhash_golay(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
