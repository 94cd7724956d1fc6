"""Quality classifier: naive Bayes support vectors.

Each text becomes a set of n-gram indicators: byte trigrams, and runs of one to three word shapes. Indicators
are scaled by the log ratio of their smoothed shares in the two classes, and a linear hinge-loss
model is fitted on them by dual coordinate descent. Its weights are interpolated with their mean magnitude: at
a blend of 1 the model is the hinge-loss model, at 0 it follows the ratios alone, as naive Bayes does. Ratios and weights come from
four fifths of the labelled rows; the last fifth maps margins to probabilities.

The model is fitted on the driver from at most ``SAMPLE_ROWS`` labelled rows (hard limit 1.2 times that), whose indicators the
executors extract. A row brings ``FEATURES`` bits (12 KB) at most, however long its text. All rows are scored on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import mix, utf8, words
from .sampling import bounded, fold
from .storage import fresh, small_batches

#: Labelled rows used for fitting.
SAMPLE_ROWS = 6000
_GRAM_BITS, _SHAPE_BITS = 16, 15
FEATURES = (1 << _GRAM_BITS) + (1 << _SHAPE_BITS)
#: Share of the hinge-loss weights in the interpolation with their mean magnitude.
BLEND = 0.25
#: A document is accepted from this score on.
ACCEPT = 0.7
_MOST_LAG = 8


def _shapes(w) -> np.ndarray:
    """A word's shape: classes of its first, second last and last byte, its length's class, and the
    distance (up to 8) to the same word before it in the document."""
    kind = np.full(256, 4, dtype=np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 3
    for i, c in enumerate(b".,!?|#$%&*:;/@-_'\""):
        kind[c] = 5 + i
    first, last = kind[w.data[w.starts]].astype(np.uint64), kind[w.data[w.ends - 1]].astype(np.uint64)
    inner = kind[w.data[np.maximum(w.ends - 2, w.starts)]].astype(np.uint64)
    size = np.minimum(w.ends - w.starts, 12).astype(np.uint64)
    lag = np.zeros(len(first), dtype=np.uint64)
    for d in range(_MOST_LAG, 0, -1):
        if len(lag) > d:
            lag[d:][(w.hashes[d:] == w.hashes[:-d]) & (w.doc[d:] == w.doc[:-d])] = d
    return ((first * np.uint64(32) + inner) * np.uint64(32) + last) * np.uint64(256) + size * np.uint64(16) + lag


def indicators(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted indicator numbers of each text of a string column without nulls."""
    offsets, data = utf8(column)
    seen = np.zeros(FEATURES, dtype=bool)
    for w in words(column, "space"):
        lo, hi = w.offsets[0], w.offsets[-1]
        b = data[lo:hi].astype(np.uint32)
        grams = ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77)) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - _GRAM_BITS) if len(b) > 2 else b[:0]
        shape = _shapes(w)
        runs = []
        for n in (1, 2, 3):
            h = np.zeros(max(0, len(shape) - n + 1), dtype=np.uint64)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + shape[i : i + len(h)] + np.uint64(n)
            runs.append((mix(h) >> np.uint64(64 - _SHAPE_BITS)).astype(np.int64) + (1 << _GRAM_BITS))
        for d in range(w.n):
            a, z = int(w.offsets[d] - lo), int(w.offsets[d + 1] - lo)
            seen[grams[a : max(a, z - 2)]] = True
            a, z = int(w.bounds[d]), int(w.bounds[d + 1])
            for n, run in enumerate(runs):
                seen[run[a : max(a, z - n)]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


@dataclass
class Model:
    """Weights of the scaled indicators, and the sigmoid from margin to probability."""

    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    @property
    def learned(self) -> bool:
        """Whether there were labels enough of both classes."""
        return bool(self.weight.any())

    def margin(self, found: np.ndarray) -> float:
        r = self.ratio[found]
        return float(r @ self.weight[found]) / max(float(np.sqrt(r @ r)), 1e-9)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -50, 50))))


def packed(found: np.ndarray) -> bytes:
    """Indicator numbers as 32-bit integers, or as a bit map where that is shorter."""
    if len(found) < FEATURES // 32:
        return found.astype(np.int32).tobytes()
    bits = np.zeros(FEATURES, dtype=bool)
    bits[found] = True
    return np.packbits(bits).tobytes()


def unpacked(row: bytes) -> np.ndarray:
    if len(row) < FEATURES // 8:
        return np.frombuffer(row, dtype=np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(row, dtype=np.uint8)))


def _dual_descent(rows: list[bytes], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int, rng) -> np.ndarray:
    """Hinge loss with L2 penalty: one dual variable a row of unit length, each solved exactly in turn."""
    norm = np.array([np.linalg.norm(ratio[unpacked(x)]) for x in rows])
    weight, alpha = np.zeros(len(ratio)), np.zeros(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            if norm[i] < 1e-9:
                continue
            x = unpacked(rows[i])
            value = ratio[x] / norm[i]
            slope = y[i] * float(value @ weight[x]) - 1
            new = min(max(alpha[i] - slope, 0.0), cost[i])
            if new != alpha[i]:
                weight[x] += (new - alpha[i]) * y[i] * value
                alpha[i] = new
    return weight


def _sigmoid_fit(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on the log loss, with targets drawn in by the class counts."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * theta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return max(float(theta[0]), 0.0), float(theta[1])


def log_ratios(rows: list[bytes], labels: np.ndarray, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of each indicator's smoothed share in class 1 to that in class 0, and which indicators occur."""
    counts = [np.full(FEATURES, smoothing), np.full(FEATURES, smoothing)]
    for x, c in zip(rows, labels, strict=True):
        counts[int(c)][unpacked(x)] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    return ratio, counts[0] + counts[1] > 2 * smoothing


def interpolated(weight: np.ndarray, used: np.ndarray, blend: float) -> np.ndarray:
    """``blend`` of each weight and the rest of the mean magnitude, over the indicators ``used``; others weigh nothing."""
    mean = float(np.abs(weight[used]).mean()) if used.any() else 0.0
    return np.where(used, blend * weight + (1 - blend) * mean, 0.0)


def fit(rows: list[bytes], labels: np.ndarray, epochs: int = 15, smoothing: float = 1.0, blend: float = BLEND, seed: int = 5) -> Model:
    """``rows``: packed indicators. A fifth of the rows calibrates and takes no part in ratios or weights. With one class or
    no rows the score is the smoothed share of label 1 everywhere."""
    zero = np.zeros(FEATURES)
    rng = np.random.default_rng(seed)
    n1 = int(labels.sum())
    if min(n1, len(labels) - n1) < 5:
        share = (n1 + 1) / (len(labels) + 2)
        return Model(zero, zero, 0.0, float(np.log(share / (1 - share))))
    held = np.zeros(len(labels), dtype=bool)
    for c in (0, 1):
        held[rng.permutation(np.flatnonzero(labels == c))[::5]] = True
    train = np.flatnonzero(~held)
    own = [rows[i] for i in train]
    ratio, used = log_ratios(own, labels[train], smoothing)
    y = np.where(labels[train] == 1, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    weight = interpolated(_dual_descent(own, y, ratio, cost, epochs, rng), used, blend)
    model = Model(ratio, weight, 1.0, 0.0)
    margins = np.array([model.margin(unpacked(rows[i])) for i in np.flatnonzero(held)])
    model.slope, model.shift = _sigmoid_fit(margins, labels[held])
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE_ROWS) -> Model:
    """Fits on the labelled rows of ``labels`` (0 or 1; the lower of several; others, and null keys, are ignored), joined with
    ``docs``; of repeated rows of a key the text that sorts first counts. The driver gets a row for each sampled key."""
    small_batches(docs.sparkSession)
    marked = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("int").alias("_label"))
    sample = bounded(marked, "_key", most)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(sample), "_key")
    rows = rows.groupBy("_key").agg(F.min("_text").alias("_text"), F.min("_label").alias("_label"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed(x) for x in indicators(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_key").cast(pa.string()), batch.column("_label"), pa.array(found, pa.binary())], ["k", "label", "found"])

    got = rows.mapInArrow(extract, "k string, label int, found binary").collect()
    got.sort(key=lambda r: (len(r.k), r.k))
    return fit([bytes(r.found) for r in got], np.array([r.label for r in got], dtype=int))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in ``into`` (replaced if there), other columns as they were.

    A null text counts as empty; equal texts score alike, whatever their length; repeated rows stay; an empty table gives an empty
    one. Only the text goes to Python, once, in batches of a few MB.
    """
    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c != into]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights, whatever the corpus

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(x) for x in indicators(texts.fill_null(""))], pa.float64())

    return docs.select(*columns, scored(F.col(text)).alias(into))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, columns as they were; the model is fitted on all labels.

    Rows are judged by their text alone: null and empty texts like each other, repeated rows and equal texts alike, null keys as
    any other. Where labels of both classes are too few to learn from, nothing is known against any row: all stay. An empty table gives an
    empty one; columns of any name stay as they are.
    """
    columns, model = docs.columns, train(docs, labels, key, text)
    if not model.learned:
        return docs
    own = fresh("_score", columns)
    return score(docs, model, text, own).where(F.col(own) >= least).select(*columns)


def op9_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 4) != 2)
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
