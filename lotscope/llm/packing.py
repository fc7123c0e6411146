"""Packing documents into sequences by order-preserving dynamic programming.

Documents keep the order in which they are stored.  Their tokens form one line, cut into windows
of at most a context's length.  A cut after a document costs nothing, one after a sentence a
little, one inside a long stretch without a sentence's end more; a window costs its padding.  The
cheapest cuts are found from left to right: with ``f`` the least cost up to a cut and ``t`` its
position, the best start of a padded window is the least ``f + t`` among those in reach, which a
monotone queue holds at its front; windows of a power of two need no padding and are looked up.
"""

from __future__ import annotations

import itertools
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.llm.common import kept_by_worker

CONTEXT = 2048
#: Appended to every document.
END_ID = 1
#: What cuts and windows cost, in tokens of padding.
SENTENCE_CUT, INSIDE_CUT, WINDOW = 8, 64, 1
#: A stretch of more than ``STRETCH`` tokens without a sentence's end may be cut every ``GRID``.
STRETCH, GRID = 128, 64
#: Tokens after which a line ends, with a document: what a worker holds at a time.  A longer
#: document is laid out in parts of this length, a multiple of the context.
LINE = CONTEXT << 7
#: Words that a worker remembers before it starts anew; the ids don't depend on it.
REMEMBERED = 1 << 20

#: How the vocabulary marks ids that end a word (fixed value); words of letters encoded at once.
WORD_END, TOGETHER = "</w>", 256
#: Texts that are encoded together.
TEXTS = 128

#: Between a letter and a punctuation mark after it the vocabulary always cuts.
SPLIT = re.compile(rb"([a-z])([^\x00-'0-9a-z\x7f-\xff])")
SENTENCE_END = re.compile(rb"[.!?][\"')\]]*\Z|(?:\xe2\x80\xa6|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)\Z")


class Grown:
    """An array that is appended to."""

    def __init__(self, kind):
        self.held, self.size = np.zeros(1 << 16, kind), 0

    def extend(self, values) -> None:
        while self.size + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)


class Encoder:
    """Ids of texts by a vocabulary that lower-cases, drops white space and never merges
    across it: distinct words are encoded once each."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        # Strings that stand for ids of their own are found before a text is lower-cased.
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.flat, self.starts, self.ends = Grown("<u4"), Grown(np.int64), Grown(bool)
        self.starts.extend([0])

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words: those of letters alone many at a time, which the ends of words take
        apart again where there are as many of them as words."""
        texts = [w.decode() for w in words]
        made: dict[str, list[int]] = {}
        letters = [w for w in texts if w.isalpha()]
        groups = [letters[i : i + TOGETHER] for i in range(0, len(letters), TOGETHER)]
        for group, ids in zip(groups, self._encoded([" ".join(g) for g in groups]), strict=True):
            stops = (np.flatnonzero(self.last[ids]) + 1).tolist() if ids else []
            if len(stops) == len(group) and stops[-1] == len(ids):
                made.update((w, ids[a:b]) for w, a, b in zip(group, [0, *stops], stops))
        rest = [w for w in texts if w not in made]
        made.update(zip(rest, self._encoded(rest), strict=True))
        found = [made[w] for w in texts]
        self.starts.extend(self.starts.held[self.starts.size - 1] + np.cumsum([len(x) for x in found]))
        self.flat.extend(list(itertools.chain.from_iterable(found)))
        self.ends.extend([SENTENCE_END.search(w) is not None for w in words])

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and the numbers of ids after which a sentence ends."""
        if len(self.index) > REMEMBERED:
            self.clear()
        known, at = len(self.index), []
        for text in texts:
            if self.special is None or not self.special.search(text):
                text = SPLIT.sub(rb"\1 \2", text.lower())
            words = text.split()
            at.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
        if len(self.index) > known:
            self._learn(list(itertools.islice(reversed(self.index), len(self.index) - known))[::-1])
        starts, ends, flat = self.starts.held, self.ends.held, self.flat.held
        for words in at:
            sizes = starts[words + 1] - starts[words]
            upto = np.cumsum(sizes)
            if not len(words) or not upto[-1]:
                yield np.zeros(0, "<u4"), np.zeros(0, np.int64)
            else:
                yield flat[np.repeat(starts[words] - upto + sizes, sizes) + np.arange(upto[-1])], upto[ends[words]]


def candidates(sizes: list[int], sentences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a line of parts of these sizes may be cut, and what each cut costs."""
    ends = np.cumsum(sizes)
    inner = np.concatenate([s + e - n for s, e, n in zip(sentences, ends, sizes, strict=True)]) if len(ends) else ends
    stops = np.unique(np.concatenate([[0], ends, inner]))
    long = np.flatnonzero(np.diff(stops) > STRETCH)
    grid = [np.arange(stops[i] + GRID, stops[i + 1], GRID) for i in long]
    at = np.unique(np.concatenate([stops, *grid])).astype(np.int64)
    cost = np.full(len(at), INSIDE_CUT, np.int64)
    cost[np.searchsorted(at, stops)] = SENTENCE_CUT
    cost[np.searchsorted(at, ends)] = 0
    return at, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, context: int = CONTEXT) -> np.ndarray:
    """Those of the positions ``at`` (ascending, the first and the last always, at most a
    context apart) at which cutting costs the least in all."""
    powers = [1 << p for p in range(context.bit_length()) if 1 << p <= context]
    before = [np.searchsorted(at, at - p) for p in powers]
    pairs = [(np.flatnonzero(at[i] == at - p), i) for p, i in zip(powers, before, strict=True)]
    to = np.concatenate([j for j, _ in pairs])
    source = np.concatenate([i[j] for j, i in pairs])
    order = np.lexsort((source, to))
    to, source = [*to[order].tolist(), -1], source[order].tolist()
    t, extra, n = at.tolist(), cost.tolist(), len(at)
    f, key, back = [0] * n, [0] * n, [0] * n
    key[0] = t[0]
    queue, head, link = [0], 0, 0
    for j in range(1, n):
        here = t[j]
        while t[queue[head]] < here - context:
            head += 1
        start = queue[head]
        least = key[start] + context - here
        while to[link] == j:
            if f[source[link]] < least:
                start = source[link]
                least = f[start]
            link += 1
        back[j] = start
        f[j] = least = least + extra[j] + WINDOW
        key[j] = least = least + here
        while len(queue) > head and key[queue[-1]] > least:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return at[cuts[::-1]]


class Line:
    """Parts of documents one after another, and the pieces that they are cut into."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []  # doc_id, ids before the part, ids of the document
        self.ids: list[np.ndarray] = []
        self.sentences: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, ids: np.ndarray, sentences: np.ndarray) -> Iterator[None]:
        """Lay a document down; it is the caller's to empty the line at every step."""
        for begin in range(0, len(ids), LINE):
            part = ids[begin : begin + LINE]
            inside = sentences[(sentences > begin) & (sentences < begin + len(part))] - begin
            self.rows.append((doc_id, begin, len(ids)))
            self.ids.append(part)
            self.sentences.append(inside)
            self.size += len(part)
            yield

    def pieces(self, first: int) -> tuple[list[list], int]:
        """The columns of all pieces, the sequences numbered from ``first``, and their number."""
        sizes = [len(x) for x in self.ids]
        cuts = best_cuts(*candidates(sizes, self.sentences))
        flat = np.concatenate(self.ids)
        ends = np.cumsum(sizes)
        stops = np.unique(np.concatenate([cuts, ends]))
        low, high = stops[:-1], stops[1:]
        part = np.searchsorted(ends, low, side="right")
        window = np.searchsorted(cuts, low, side="right") - 1
        begins = (ends - sizes)[part]
        rows = [self.rows[p] for p in part.tolist()]
        columns = [
            [r[0] for r in rows],
            [r[1] + s for r, s in zip(rows, (low - begins).tolist(), strict=True)],
            (high - low).tolist(),
            [flat[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)],
            [r[2] for r in rows],
            (window + first).tolist(),
            (low - cuts[window]).tolist(),
        ]
        return columns, len(cuts) - 1


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Sequences that a partition may number.
NUMBERS = 1 << 40


def _packer(vocabulary: Callable[[], str], fields) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(fields)
        text = vocabulary()
        encoder = kept_by_worker(("packing", hash(text)), lambda: Encoder(text))
        number = TaskContext.get().partitionId() * NUMBERS
        line = Line()

        def emptied() -> pa.RecordBatch:
            nonlocal number
            columns, used = line.pieces(number)
            number += used
            line.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                doc_ids, texts = (c.to_pylist() for c in batch.slice(first, TEXTS).columns)
                made = encoder.encode([t or b"" for t in texts])
                for doc_id, (ids, sentences) in zip(doc_ids, made, strict=True):
                    for _ in line.add(doc_id, np.append(ids, np.uint32(END_ID)), sentences):
                        if line.size >= LINE:
                            yield emptied()
        if line.rows:
            yield emptied()

    return run


def packed(docs: DataFrame, path: str) -> DataFrame:
    """The pieces of all whole texts of ``docs`` (doc_id, text; further columns are passed over):
    ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids`` (4 bytes each,
    little endian), ``doc_tokens`` (ids of the document with the closing one), ``sequence_id`` and
    ``offset`` (in the sequence).  Every id lies in one piece.

    A null text counts as empty, which is its closing id; null and repeated doc_ids are carried
    along, repeated rows are documents of their own, and an empty table has no pieces.
    Documents are packed where they lie, in the order stored, so nothing is shuffled and no
    group of rows is gathered; sequences are numbered within each partition.  Each partition
    and each ``LINE`` of tokens ends a sequence, which costs at most one padded window.
    """
    with open(path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = docs.sparkSession.createDataFrame([], PIECES).schema
    wanted = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return wanted.mapInArrow(_packer(lambda: sent.value, fields), fields)


def op11_packing(docs: DataFrame, path: str) -> DataFrame:
    return packed(docs, path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
