"""Language-model scores from a log-frequency Bloom filter.

The filter holds, for every n-gram of the training documents, its count rounded to a power of
``BASE``: the n-gram is put in once for each step up to its step, so a count is read by asking
for one step after another until the answer is no.  A wrong yes makes a count too large, never
too small.  The filter is built in segments, each from the n-grams whose hash falls into it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.llm.common import LOWER_ASCII, checkpointed, rows_with

ORDER = 2
BASE = 1.5
BITS_PER_KEY, PROBES = 8, 4
#: Share of the probability that goes by the longest n-gram; the rest by the token alone.
TRUST = 0.4
#: Tokens of the corpus for each segment of the filter.
SEGMENT_TOKENS = 2_000_000
#: Bytes of the filter that a worker holds at a time.  Documents pass by a larger filter in
#: several rounds, each with some of its segments.
HELD_BYTES = 256 << 20
#: Tokens with at least this share of all are looked up in a table that every worker holds;
#: there are at most 1 / HEAD_SHARE of them.  All others are joined.
HEAD_SHARE = 5e-7
#: Tokens handled at once.
CHUNK = 200_000
END = b""
FOLDS = 5


def tokens_of(text: bytes | None) -> list[bytes]:
    """The words of a text and one end (an empty token: no word is empty)."""
    return [*(text or b"").translate(LOWER_ASCII).split(), END]


def held_out(doc_id: Column) -> Column:
    digest = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(digest, F.lit(FOLDS)) == 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)


def ngrams(tokens: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each token, for n from 1 to ``ORDER``.  ``before``
    has, for each n from 2, the hash of the token n - 1 places earlier."""
    made = [mixed(tokens)]
    for n in range(1, ORDER):
        made.append(mixed(made[-1] * np.uint64(3) + mixed(before[n - 1]) + np.uint64(n)))
    return made


def chunks(texts: list[bytes | None]):
    """Hashes of the tokens of some documents at a time, those before them (ends before the
    first), and the number of tokens of each document."""
    end, many, counts, size = hashes([END])[0], [], [], 0
    for i, text in enumerate(texts):
        many.append(hashes(tokens_of(text)))
        counts.append(len(many[-1]))
        size += counts[-1]
        if size >= CHUNK or i + 1 == len(texts):
            before = [
                np.concatenate([np.concatenate([np.full(min(n, len(t)), end), t[:-n]]) for t in many])
                for n in range(1, ORDER)
            ]
            yield np.concatenate(many), before, counts
            many, counts, size = [], [], 0


def steps_of(count: np.ndarray) -> np.ndarray:
    """The step of a count: 1 for the count 1, more for larger ones."""
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


def counts_of(limit: int = 128) -> np.ndarray:
    """By step, the middle of the counts that have it; 0 at step 0."""
    low = np.ceil(BASE ** np.arange(limit) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** np.arange(1, limit + 1) - 1e-9) - 1)
    return np.concatenate([[0], (low + high) / 2])


COUNTS = counts_of()


def places(keys: np.ndarray, stride: np.ndarray, step: int, size: int | np.ndarray):
    """The bits of n-grams at a step, one after another, in segments of ``size`` bits (less
    than 2^32)."""
    first = mixed(keys + np.uint64(0x9E3779B97F4A7C15 * step % (1 << 64)))
    for i in range(PROBES):
        yield ((first + np.uint64(i) * stride) >> np.uint64(32)) * np.asarray(size, np.uint64) >> np.uint64(32)


def strides(keys: np.ndarray) -> np.ndarray:
    return mixed(~keys) | np.uint64(1)


def built(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bytes of a segment that holds distinct n-grams with their counts."""
    steps, stride = steps_of(counts), strides(keys)
    size = max(64, int(steps.sum()) * BITS_PER_KEY // 64 * 64)
    bits = np.zeros(size, bool)
    step = 1
    while len(keys):
        for at in places(keys, stride, step, size):
            bits[at] = True
        step += 1
        more = steps >= step
        keys, steps, stride = keys[more], steps[more], stride[more]
    return np.packbits(bits)


def _segment_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def filter_segments(docs: DataFrame, bits: int) -> DataFrame:
    """``segment`` and its ``bytes`` for the n-grams of all ``docs`` (text), in 2^bits
    segments.  A key keeps 48 bits after its segment's; batches send each once."""

    def sent(texts):
        segments, kept, counts = [], [], []
        for tokens, before, _ in chunks(texts):
            keys, n = np.unique(np.concatenate(ngrams(tokens, before)), return_counts=True)
            segment = _segment_of(keys, bits)
            edges = np.flatnonzero(np.diff(segment, prepend=-1))
            rest = (keys << np.uint64(bits)) >> np.uint64(16)
            for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
                segments.append(int(segment[a]))
                kept.append(rest[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                counts.append(n[a:b].astype("<u4").tobytes())
        return [segments, kept, counts]

    pieces = rows_with(docs, {"text": "cast(text as binary)"}, "segment bigint, keys binary, counts binary", sent)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        six = np.frombuffer(b"".join(frame["keys"]), np.uint8).reshape(-1, 6)
        keys = np.zeros((len(six), 8), np.uint8)
        keys[:, :6] = six
        n = np.frombuffer(b"".join(frame["counts"]), "<u4")
        distinct, at = np.unique(keys.view("<u8").ravel(), return_inverse=True)
        total = np.bincount(at, weights=n).astype(np.int64)
        return pd.DataFrame({"segment": frame["segment"].iloc[:1], "bytes": [built(distinct, total).tobytes()]})

    return pieces.groupBy("segment").applyInPandas(merge, "segment bigint, bytes binary")


class Held:
    """Some segments of a filter, one after another in ``content``, with their lengths."""

    def __init__(self, bits: int, lengths: dict[int, int], content: bytes):
        self.bits = bits
        self.start, self.size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.uint64)
        end = 0
        for segment, length in lengths.items():
            self.start[segment], self.size[segment] = end, length * 8
            end += length
        self.content = np.frombuffer(content, np.uint8)

    def fill(self, keys: np.ndarray, steps: np.ndarray) -> None:
        """Writes the steps of the n-grams whose segments are held.  Each distinct one is
        looked up once, and dropped at the first bit that isn't set."""
        distinct, at = np.unique(keys, return_inverse=True)
        segment = _segment_of(distinct, self.bits)
        held = self.size[segment] > 0
        found, live = np.zeros(len(distinct), np.int64), np.flatnonzero(held)
        rest = ((distinct << np.uint64(self.bits)) >> np.uint64(16))[live]
        start, size, stride, step = self.start[segment[live]], self.size[segment[live]], strides(rest), 1
        while len(live):
            kept = np.arange(len(live))
            for i, place in enumerate(places(rest, stride, step, size)):
                place = place if i == 0 else place[kept]
                byte = self.content[start[kept] + (place >> np.uint64(3)).astype(np.int64)]
                kept = kept[(byte >> (7 - (place & np.uint64(7))).astype(np.uint8) & 1).astype(bool)]
            live, rest, start, size, stride = live[kept], rest[kept], start[kept], size[kept], stride[kept]
            found[live] = step
            step += 1
        steps[held[at]] = found[at][held[at]]


def log10_probabilities(steps: list[np.ndarray], counts: list[int], total: int, distinct: int) -> np.ndarray:
    """Of each token, from the steps of the n-grams that end there.  ``counts`` has the number
    of tokens of each document; the context of its first one is its end.

    The longer n-gram can't be more frequent than its parts, which corrects many a wrong yes.
    """
    one = COUNTS[steps[0]]
    given = (one + 0.5) / (total + 0.5 * (distinct + 1))
    ends = np.cumsum(counts)
    before = np.roll(one, 1)
    before[ends - counts] = one[ends - 1]
    for of in steps[1:]:
        pair = np.minimum(COUNTS[of], np.minimum(one, before))
        seen = before > 0
        given = np.where(seen, TRUST * pair / np.where(seen, before, 1) + (1 - TRUST) * given, given)
    return np.log10(given)


@dataclass
class Trained:
    counts: DataFrame  # token, c
    head: dict[bytes, int]
    total: int
    distinct: int
    bits: int
    segments: DataFrame


def train(docs: DataFrame, segment_tokens: int = SEGMENT_TOKENS) -> Trained:
    """The exact token counts and the filter of ``docs`` (text)."""

    def counted(texts):
        found = Counter()
        for text in texts:
            found.update(tokens_of(text))
        return [list(found), list(found.values())]

    counts = rows_with(docs, {"text": "cast(text as binary)"}, "token binary, c bigint", counted)
    counts = checkpointed(counts.groupBy("token").agg(F.sum("c").alias("c")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = counts.filter(F.col("c") >= max(1, total * HEAD_SHARE)).collect()
    bits = max(0, int(np.ceil(np.log2(max(1, total) * ORDER / segment_tokens))))
    return Trained(
        counts, {bytes(t): c for t, c in head}, total, distinct, bits, checkpointed(filter_segments(docs, bits))
    )


def _rounds(model: Trained, held_bytes: int) -> list[list[int]]:
    """Segments of each round, by their measured sizes."""
    rounds, size = [[]], 0
    for segment, n in sorted(model.segments.select("segment", F.octet_length("bytes")).collect()):
        if rounds[-1] and size + n > held_bytes:
            rounds.append([])
            size = 0
        rounds[-1].append(segment)
        size += n
    return rounds


def scores(docs: DataFrame, model: Trained, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of each row.

    Null and empty texts are the end alone.  Repeated rows are scored alike.
    """
    spark = docs.sparkSession
    head, total, distinct = spark.sparkContext.broadcast(model.head), model.total, model.distinct
    scale = np.log10(total + 0.5 * (distinct + 1))
    now = docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("text").cast("binary").alias("text"),
        F.lit(None).cast("binary").alias("steps"),
    )
    rounds = _rounds(model, held_bytes)
    for i, wanted in enumerate(rounds):
        last = i + 1 == len(rounds)
        parts = model.segments.filter(F.col("segment").isin(wanted)).collect() if wanted else []
        sent = spark.sparkContext.broadcast(({s: len(b) for s, b in parts}, b"".join(b for _, b in parts)))
        del parts

        def read(texts, steps, sent=sent, ready=[]):  # noqa: B006
            """Of some documents: how many tokens each has, and the steps of their n-grams."""
            if not ready:
                ready.append(Held(model_bits, *sent.value))
            begun = 0
            for tokens, before, counts in chunks(texts):
                keys = ngrams(tokens, before)
                # Earlier rounds' steps lie in a row for each n.
                known = [np.zeros(len(tokens), np.int64) for _ in range(ORDER)]
                if steps[begun] is not None:
                    rows = [np.frombuffer(s, np.uint8).reshape(ORDER, -1) for s in steps[begun : begun + len(counts)]]
                    known = list(np.concatenate(rows, axis=1).astype(np.int64))
                for k, s in zip(keys, known, strict=True):
                    ready[0].fill(k, s)
                begun += len(counts)
                yield counts, known

        model_bits = model.bits
        if not last:

            def passed(uids, ids, texts, steps, read=read):
                out = []
                for counts, known in read(texts, steps):
                    rows = np.stack(known).astype(np.uint8)
                    out += [part.tobytes() for part in np.split(rows, np.cumsum(counts)[:-1], axis=1)]
                return [uids, ids, texts, out]

            now = checkpointed(rows_with(
                now, {c: c for c in ("uid", "doc_id", "text", "steps")},
                "uid bigint, doc_id bigint, text binary, steps binary", passed,
            ))
            continue

        def ended(uids, ids, texts, steps, read=read):
            score, sizes = [], []
            for counts, known in read(texts, steps):
                each = log10_probabilities(known, counts, total, distinct)
                score += np.add.reduceat(each, np.cumsum([0, *counts[:-1]])).tolist()
                sizes += counts
            found, sums, rest = [], [], []
            for text in texts:
                counts = [(t, head.value.get(t)) for t in tokens_of(text)]
                own = [c for _, c in counts if c is not None]
                found.append(len(own))
                sums.append(float(np.log10(np.array(own) + 0.5).sum()) if own else 0.0)
                rest.append([t for t, c in counts if c is None])
            joined = [b" ".join(t) for t in rest]
            none = [0 if not r else len(r) for r in rest]
            return [uids, ids, sizes, found, sums, score, joined, none]

        made = rows_with(
            now, {c: c for c in ("uid", "doc_id", "text", "steps")},
            "uid bigint, doc_id bigint, n_tokens bigint, n_head bigint, head_sum double, score double, rest binary, n_rest bigint",
            ended,
        )
    made = checkpointed(made)
    # No token holds a blank.  A missing end (no training documents) is an empty string here.
    each = made.filter("n_rest > 0").select("uid", F.explode(F.split(F.col("rest").cast("string"), " ")).alias("token"))
    each = each.withColumn("token", F.col("token").cast("binary"))
    rare = model.counts.filter(F.col("c") < max(1, total * HEAD_SHARE))
    known = each.join(rare, "token").groupBy("uid").agg(
        F.count("*").alias("n"), F.sum(F.log10(F.col("c") + 0.5)).alias("s")
    )
    unknown = F.col("n_rest") - F.coalesce("n", F.lit(0))
    base = F.col("head_sum") + F.coalesce("s", F.lit(0.0)) + unknown * F.log10(F.lit(0.5)) - F.col("n_tokens") * F.lit(float(scale))
    return made.join(known, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("n_head") + F.coalesce("n", F.lit(0))).alias("n_known"), base.alias("base_score"), "score"
    )


def op7_bloom_lm(docs: DataFrame) -> DataFrame:
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return scores(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score",
    )
