"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of the benchmark texts.  For all patterns of one length, a shift
table over blocks of two words says how far the search may jump; where the shift is zero the
block is the end of some pattern, its bucket gives the candidates, and a comparison of all
words confirms each.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.llm.common import LOWER_ASCII, checkpointed, rows_with

WINDOW = 10
#: Bytes of benchmark text that one search may hold.  A larger benchmark is searched for in
#: several passes, each with a part of its items.
PART_BYTES = 32 << 20

#: For ``bytes.translate``: A-Z to a-z, every byte that is not part of a word to a blank.
WORD_BYTES = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).translate(LOWER_ASCII)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


@dataclass
class Length:
    """The patterns of one number of words."""

    size: int
    patterns: dict[tuple, list] = field(default_factory=lambda: defaultdict(list))
    shift: dict[tuple, int] = field(default_factory=dict)
    buckets: dict[tuple, list[tuple]] = field(default_factory=lambda: defaultdict(list))

    def prepare(self) -> None:
        block = min(2, self.size)
        for pattern in self.patterns:
            for end in range(block, self.size + 1):
                at = pattern[end - block : end]
                self.shift[at] = min(self.shift.get(at, self.size), self.size - end)
            self.buckets[pattern[self.size - block :]].append(pattern)

    def search(self, words: list[bytes]) -> list[tuple[int, tuple]]:
        """Start and pattern of every occurrence, in order."""
        found, size, block = [], self.size, min(2, self.size)
        most, shift, end, last = size - block + 1, self.shift.get, size, len(words)
        while end <= last:
            at = tuple(words[end - block : end])
            step = shift(at, most)
            if step:
                end += step
                continue
            start = end - size
            first, whole = words[start], None
            for pattern in self.buckets[at]:
                if pattern[0] == first:
                    whole = whole or tuple(words[start:end])
                    if pattern == whole:
                        found.append((start, pattern))
            end += 1
        return found


class Search:
    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW):
        self.lengths: dict[int, Length] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            if not size:
                continue
            of = self.lengths.setdefault(size, Length(size))
            for pattern in {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}:
                of.patterns[pattern].append(item)
        for of in self.lengths.values():
            of.prepare()

    def find(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, the hit ranges of words (end exclusive, joined), the items."""
        words, ranges, items = words_of(text), [], set()
        for of in self.lengths.values():
            for start, pattern in of.search(words):
                ranges.append((start, start + of.size))
                items.update(of.patterns[pattern])
        return len(words), joined(ranges), items


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


FOUND = "n_words bigint, starts array<bigint>, ends array<bigint>, items array<bigint>"


def _searched(docs: DataFrame, items: list, columns: str, names: list[str]) -> DataFrame:
    """One pass over ``docs``, merged with what earlier passes found in them."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    ready: list[Search] = []

    def rows(*given):
        if not ready:
            ready.append(Search(sent.value))
        out = []
        for text, starts, ends, before in zip(*given[-4:], strict=True):
            n, ranges, found = ready[0].find(text)
            ranges = joined(ranges + list(zip(starts, ends, strict=True)))
            out.append((n, [r[0] for r in ranges], [r[1] for r in ranges], sorted({i for i in found if i is not None} | set(before))))
        return [*given[:-4], given[-4], *([r[i] for r in out] for i in range(4))]

    return rows_with(
        docs,
        {**{n: f"`{n}`" for n in names}, "_text": "_text", "starts": "starts", "ends": "ends", "items": "items"},
        f"{columns}, _text binary, {FOUND}",
        rows,
    )


def found_in(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES, content: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, the hit ranges of words as ``starts`` and ``ends`` (exclusive,
    disjoint, ascending) and the ascending ``items`` with an occurring window, for every row
    of ``docs`` (doc_id, text); with ``content`` also a hash of the text of that name.

    Null texts have no words; neither side's other columns matter.  A benchmark row without
    item_id marks words but names no item; rows that share an item_id are one item.  The
    benchmark's size is measured first: each pass holds at most ``part_bytes`` of it (one
    longer text makes a part of its own).
    """
    none = "cast(array() as array<bigint>)"
    own = {"doc_id": F.col("doc_id")} | ({"content": F.xxhash64("text")} if content else {})
    columns = ", ".join(f"{c} bigint" for c in own)
    now = docs.select(*(e.alias(c) for c, e in own.items()), F.col("text").cast("binary").alias("_text"), *(F.expr(none).alias(c) for c in ("starts", "ends", "items")))
    wanted = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    total = wanted.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for i in range(parts):
        items = [tuple(r) for r in wanted.filter(part == i).collect()]
        now = _searched(now, items, columns, list(own))
        if i + 1 < parts:
            now = checkpointed(now)
    return now.drop("_text")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any hit, columns unchanged.

    A hit drops the rows of its doc_id and text (by hash), not others with that doc_id or
    without any.
    """
    bad = found_in(docs, benchmark, content=True).filter(F.size("starts") > 0)
    bad = bad.select(F.col("doc_id").alias("_bad"), F.col("content").alias("_bad_content")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs["text"]) == bad["_bad_content"])
    return docs.join(bad, same, "left_anti")


def op5_wu_manber(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found_in(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
