"""A quality classifier on document statistics.

Random Fourier features turn ridge regression into an approximate Gaussian-kernel machine. Each of a fixed number of
partitions sums its part of the normal equations, the driver adds and solves them, and an isotonic fit over score bins turns
scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilake.llm.common import texts_of
from vigilake.session import cut_lineage

#: Partitions the labelled rows are summed in: that many matrices reach the driver, whatever the number of rows.
SUMS = 24
RANDOM_FEATURES = 256
RIDGE = 1e-2
BINS = 400
SEED = 20240601
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", ".", ",", "!", "?", "|", "#$%&*@^~=_+<>\\", "-/:;", "()[]{}\"'`")
_LOOKUP = np.array([[chr(b) in c for b in range(128)] + [False] * 128 for c in _CLASSES] + [[False] * 128 + [True] * 128], dtype=float)
FEATURES = len(_LOOKUP) + 14


def text_statistics(text: bytes) -> list[float]:
    """Statistics of a whole text: shares of character classes, words, lines and repeats."""
    size = len(text)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) if size else np.zeros(256)
    shares = _LOOKUP @ counts / max(size, 1)
    words, lines = text.split(), text.split(b"\n")
    n = len(words)
    if n:
        different = set(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        pairs = len(set(zip(words, words[1:])))
        first = [w[0] for w in words]
        more = [
            lengths.mean(), lengths.std(), (lengths <= 3).mean(), (lengths >= 12).mean(), len(different) / n,
            np.log(len(different) + 1.0) / np.log(n + 1.0), pairs / max(n - 1, 1), sum(65 <= c <= 90 for c in first) / n,
            sum(w.isupper() for w in words) / n, sum(not w.isalnum() for w in words) / n,
        ]
    else:
        more = [0.0] * 10
    used = counts[counts > 0] / max(size, 1)
    more += [np.log1p(n), np.log1p(len(lines)), len(set(lines)) / len(lines), float(-(used * np.log2(used)).sum())]
    return [*shares.tolist(), *map(float, more)]


def statistics(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, x) with the statistics of every whole text; null is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_statistics(text) for text in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "x"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), FEATURES)


@dataclass(frozen=True)
class Model:
    """All a task needs to score: a few hundred kilobytes whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """A constant, the standardised statistics and the random waves."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / len(self.phase)) * np.cos(z @ self.waves + self.phase)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: the isotonic levels, joined by straight lines."""
        return np.clip(np.interp(self.raw(x), self.edges, self.levels), 0.0, 1.0)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Closest rising sequence: neighbours out of order are pooled to their mean."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def _summed(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations over all rows (x, y): each partition adds up its own."""
    width = 1 + FEATURES + len(model.phase)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width + 1))
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                f = model.features(_matrix(part.column("x")))
                gram += f.T @ np.hstack([f, part.column("y").to_numpy(zero_copy_only=False).reshape(-1, 1)])
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary())], names=["gram"])

    total = np.zeros((width, width + 1))
    for row in rows.mapInArrow(run, "gram binary").toLocalIterator():
        total += np.frombuffer(row.gram).reshape(width, width + 1)
    return total[:, :-1], total[:, -1]


def fit(rows: DataFrame, seed: int = SEED) -> Model:
    """Fit on labelled statistics: columns doc_id, x, y (0 or 1). All rows are used, whatever their number.

    Three quarters (by hash of doc_id) fit the ridge scores, the last quarter the calibration. What reaches the driver
    is bounded: means, ``SUMS`` matrices and ``BINS`` bins. Without labels every score is one half.
    """
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(4))
    rows = cut_lineage(rows.select("x", F.col("y").cast("double").alias("y"), part.alias("fold")).repartition(SUMS))
    value = lambda i: F.get("x", i).cast("double")
    moments = rows.agg(F.count("*"), F.avg("y"), *[F.avg(value(i)) for i in range(FEATURES)], *[F.stddev_pop(value(i)) for i in range(FEATURES)]).first()
    rng = np.random.default_rng(seed)
    waves = rng.normal(size=(FEATURES, RANDOM_FEATURES)) / np.sqrt(FEATURES)
    phase = rng.uniform(0, 2 * np.pi, RANDOM_FEATURES)
    n = moments[0]
    mean = np.array(moments[2 : 2 + FEATURES], dtype=float) if n else np.zeros(FEATURES)
    scale = np.array(moments[2 + FEATURES :], dtype=float) if n else np.ones(FEATURES)
    scale = np.where(scale > 1e-9, scale, 1.0)
    flat = np.array([0.5, 0.5])
    model = Model(mean, scale, waves, phase, np.zeros(1 + FEATURES + RANDOM_FEATURES), np.array([0.0, 1.0]), flat)
    if not n:
        return model
    gram, right = _summed(rows.where("fold <> 3").select("x", "y"), model)
    penalty = np.full(len(gram), RIDGE * max(gram[0, 0], 1.0) / 100)
    penalty[0] = 1e-9
    weights = np.linalg.solve(gram + np.diag(penalty), right)
    model = Model(mean, scale, waves, phase, weights, model.edges, flat)
    bins = rows.where("fold = 3").mapInArrow(_binner(model), "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if not bins:
        rate = float(moments[1])
        return Model(mean, scale, waves, phase, weights, model.edges, np.array([rate, rate]))
    # one label of each kind at the ends keeps a bin of few rows from certainty
    at = np.array([(b.bin + 0.5) / BINS * 2 - 0.5 for b in bins])
    n_bin = np.array([b.n for b in bins], dtype=float)
    levels = isotonic(np.array([b.y for b in bins]) / n_bin, n_bin)
    centres, inverse = np.unique(levels, return_inverse=True)
    weight = np.bincount(inverse, n_bin)
    edges = np.bincount(inverse, at * n_bin) / weight
    centres = (centres * weight + 0.5) / (weight + 1)
    return Model(mean, scale, waves, phase, weights, edges, np.maximum.accumulate(centres))


def _binner(model: Model):
    """Score bins of the calibration rows; raw scores lie around 0 and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.clip((model.raw(_matrix(batch.column("x"))) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["bin", "y"])

    return run


def scores(stats: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score) for all statistics rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))))], names=["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, f"doc_id {dict(stats.dtypes)['doc_id']}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None) -> DataFrame:
    """Score every document: doc_id, score (0 to 1, higher: label 1 likelier).

    ``labels`` has doc_id and quality; labels whose doc_id fails ``may_learn`` are never read, null labels neither, and
    of several labels of a doc_id the largest counts. Inputs are statistics of the text and nothing else. Null is the
    empty text and gets a score like any other; rows that repeat a doc_id each get theirs. Without any label the score
    is one half. An empty table gives no rows.
    """
    stats = cut_lineage(statistics(docs))
    known = labels.where(F.col("quality").isNotNull())
    if may_learn is not None:
        known = known.where(may_learn)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("y"))
    model = fit(stats.join(known, "doc_id").select("doc_id", "x", "y"))
    return scores(stats, model)


def keep_good(docs: DataFrame, labels: DataFrame, at_least: float, may_learn: Column | None = None) -> DataFrame:
    """The documents that score ``at_least`` that much, all columns as they were; labels as in :func:`quality_scores`.

    Every row is judged by its own text. The texts are read twice and never shuffled.
    """
    stats = cut_lineage(statistics(docs))
    known = labels.where(F.col("quality").isNotNull())
    if may_learn is not None:
        known = known.where(may_learn)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("y"))
    model = fit(stats.join(known, "doc_id").select("doc_id", "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([text_statistics(text) for text in texts_of(batch.column("text"))])
                yield batch.filter(pa.array(model.score(x) >= at_least))

    return docs.mapInArrow(run, docs.schema)
