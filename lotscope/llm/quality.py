"""Quality scores from statistics of whole texts.

Random Fourier features stand in for a Gaussian kernel over the statistics.  A ridge
regression on them is solved from normal equations, which the partitions sum up; its scores
are calibrated by an isotonic fit on rows that their regression hasn't seen.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.llm.common import checkpointed, rows_with

FEATURES = 256
#: Width of the kernel, in standard deviations of a statistic.
WIDTH = 4.0
RIDGE = 1.0
SEED = 20240607
FOLDS = 5
THRESHOLD = 0.3
#: Raw scores are calibrated in so many equal steps from -0.5 to 1.5.
BINS = 4096
#: Rows over which the partitions' sums are added up before the driver adds the rest.
SLOTS = 16
SYMBOLS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
MARKUP = np.frombuffer(b"#$%&*+<=>@[\\]^_`{|}~", np.uint8)
N_STATISTICS = 20


def statistics(text: bytes | None) -> list[float]:
    """Numbers that describe a UTF-8 text; those of a null text are those of an empty one."""
    text = text or b""
    n = max(1, len(text))
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.lower().split()
    n_words = max(1, len(words))
    distinct = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    triples = set(zip(words, words[1:], words[2:])) if len(words) > 2 else set()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    odd_end = sum(1 for w in words if w[-1:] in b"#$%&*!|")
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)),
        lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        bytes_[65:91].sum() / n, bytes_[48:58].sum() / n, bytes_[128:].sum() / n,
        bytes_[SYMBOLS].sum() / n, bytes_[MARKUP].sum() / n, bytes_[33] / n,
        (bytes_[44] + bytes_[46]) / n_words, odd_end / n_words,
        len(distinct) / n_words, max(distinct.values(), default=0) / n_words,
        len(triples) / max(1, len(words) - 2), len(set(lines)) / n_lines,
        np.log1p(len(text) / n_lines), len(zlib.compress(text, 1)) / (n + 16),
    ]


def described(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the statistics, of every row."""
    return rows_with(
        docs,
        {"doc_id": "doc_id", "text": "cast(text as binary)"},
        "doc_id bigint, x array<double>",
        lambda ids, texts: [ids, [list(map(float, statistics(t))) for t in texts]],
    )


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random features of the standardised statistics, and a constant."""
        random = np.random.default_rng(SEED)
        direction = random.normal(0, 1 / WIDTH, (x.shape[1], FEATURES))
        phase = random.uniform(0, 2 * np.pi, FEATURES)
        near = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(near @ direction + phase), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.values[0])
        return np.interp(self.features(x) @ self.weights, self.knots, self.values)


def _sums(model: Model, batches):
    """Normal equations of each fold, summed over the rows of a task."""
    size = FEATURES + 1
    total = np.zeros((FOLDS, size, size + 1))
    seen = False
    for batch in batches:
        z = model.features(np.stack(batch["x"].to_list()).reshape(-1, N_STATISTICS))
        y = batch["y"].to_numpy()
        for k in range(FOLDS):
            of = batch["fold"].to_numpy() == k
            total[k] += z[of].T @ np.column_stack([z[of], y[of]])
            seen = seen or of.any()
    if seen:
        for k in range(FOLDS):
            yield pd.DataFrame({"fold": [k], "sums": [total[k].tobytes()]})


def _added(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, sums in zip(batch["fold"], batch["sums"], strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(sums)
    yield pd.DataFrame({"fold": list(total), "sums": [t.tobytes() for t in total.values()]})


def _solved(sums: np.ndarray) -> np.ndarray:
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-6
    return np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])


def isotonic(at: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to the means ``total / count`` at ascending ``at``:
    centre and value of its steps.  A row of either label is added to each step, so that no
    value is 0 or 1."""
    steps: list[list[float]] = []
    for a, t, c in zip(at, total, count, strict=True):
        steps.append([a * c, t, c])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            top = steps.pop()
            steps[-1] = [x + y for x, y in zip(steps[-1], top, strict=True)]
    centre = np.array([a / c for a, _, c in steps])
    return centre, np.maximum.accumulate([(t + 0.5) / (c + 1) for _, t, c in steps])


def fit(described_docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels`` (doc_id, quality) from the statistics of ``described_docs``.

    Rows whose fold is 0 are not learnt from.  Repeated labels of a document count as their
    mean; null labels and labels of no document as none.  With one kind of label only, or
    none, every score is that label's smoothed share.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    learnt = described_docs.withColumn("fold", fold(F.col("doc_id"))).filter("fold <> 0").join(known, "doc_id")
    learnt = checkpointed(learnt.select("x", "y", "fold"))
    columns = [F.element_at("x", i + 1) for i in range(N_STATISTICS)]
    row = learnt.agg(
        F.count("*"), F.avg("y"), F.min("y"), F.max("y"), *(F.avg(c) for c in columns), *(F.stddev_pop(c) for c in columns)
    ).first()
    n, share, low, high = row[:4]
    if not n or low == high:
        value = ((share or 0.0) * n + 0.5) / (n + 1)
        return Model(*(np.zeros(0) for _ in range(4)), np.array([value]))
    moments = np.array(row[4:], float).reshape(2, -1)
    model = Model(moments[0], np.where(moments[1] > 1e-9, moments[1], 1), *(np.zeros(0) for _ in range(3)))

    parts = learnt.mapInPandas(lambda b: _sums(model, b), "fold int, sums binary")
    parts = parts.repartition(SLOTS, F.spark_partition_id()).mapInPandas(_added, "fold int, sums binary")
    sums = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
    for k, part in parts.collect():
        sums[k] += np.frombuffer(part).reshape(sums.shape[1:])
    model.weights = _solved(sums.sum(axis=0))
    # Scores of a fold come from the sums of the others.
    unseen = [_solved(sums.sum(axis=0) - sums[k]) for k in range(FOLDS)]

    def raw(batches):
        for batch in batches:
            z = model.features(np.stack(batch["x"].to_list()).reshape(-1, N_STATISTICS))
            score = np.einsum("ij,ij->i", z, np.stack(unseen)[batch["fold"].to_numpy()])
            at = np.clip(np.floor((score + 0.5) / 2 * BINS), 0, BINS - 1).astype("i8")
            yield pd.DataFrame({"at": at, "y": batch["y"]})

    steps = learnt.mapInPandas(raw, "at bigint, y double").groupBy("at").agg(F.sum("y"), F.count("*")).collect()
    at, total, count = np.array(sorted(map(tuple, steps)), float).T
    model.knots, model.values = isotonic((at + 0.5) / BINS * 2 - 0.5, total, count)
    return model


def scorer(model: Model):
    """A function of a column of texts that gives their scores."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = [statistics(t.encode() if isinstance(t, str) else None) for t in texts]
        return pd.Series(model.score(np.array(x, float).reshape(-1, N_STATISTICS)))

    return score


def scored(described_docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row of ``described_docs``."""

    def run(batches):
        for batch in batches:
            x = np.stack(batch["x"].to_list()).reshape(-1, N_STATISTICS)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.score(x)})

    return described_docs.mapInPandas(run, "doc_id bigint, score double")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score at least ``THRESHOLD``, columns unchanged.

    A null text scores as an empty one.  Repeated rows stay or go together.
    """
    model = fit(described(docs), labels)
    return docs.filter(scorer(model)(F.col("text")) >= THRESHOLD)


def op2_quality_rff(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = checkpointed(described(docs))
    found = scored(known, fit(known, labels))
    return found.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
