"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams; a linear layer and a softmax
give the languages' probabilities. Both are trained by stochastic gradient descent in numpy. A
part of the sample, kept apart, sets the softmax temperature and the score below which a
prediction is rejected.

The model is fitted on the driver from at most ``SAMPLE_ROWS`` labelled rows (hard limit 1.2 times that), which the executors
turn into counts of n-grams, all of them: at most 192 KB a training row, whatever its length. Scoring uses
all n-grams of whole texts. Since the layers are linear, it needs one table of n-gram bucket by language, which is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import spans_of_docs, utf8
from .sampling import bounded, fold
from .storage import fresh, small_batches

#: Labelled rows used for fitting, and bytes that their n-grams may take: longer texts, fewer rows.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 256 << 20
BUCKETS = 1 << 15
SIZES = (2, 3, 4)
UNDETERMINED = "und"
#: Share of right predictions among those not rejected, on the rows that calibrate.
PRECISION = 0.995


def _normal() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    table[65:91] += 32
    table[:97] = np.where((table[:97] >= 97) & (table[:97] < 123), table[:97], 32)
    table[123:128] = 32
    return table


def grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(first document, byte offsets, buckets by size of the n-grams that start at each byte), for runs of documents."""
    offsets, data = utf8(column)
    table = _normal()
    for lo, hi in spans_of_docs(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        b = table[data[offsets[lo] : offsets[hi]]]
        by_size = []
        for n in SIZES:
            h = np.full(max(0, len(b) - n + 1), n, dtype=np.uint32)
            for i in range(n):
                h = h * np.uint32(0x01000193) + b[i : i + len(h)]
            by_size.append((h * np.uint32(0x9E3779B1) >> np.uint32(17)).astype(np.int64))
        yield lo, at, by_size


def _own(at: np.ndarray, d: int, n: int) -> slice:
    """Where the n-grams inside document ``d`` start."""
    return slice(int(at[d]), max(int(at[d]), int(at[d + 1]) - n + 1))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # float32, language by bucket
    shift: np.ndarray
    temperature: float
    least: float  # scores below are rejected

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)

    def logits(self, column: pa.Array) -> np.ndarray:
        """A row for each text of a string column without nulls."""
        out = np.zeros((len(column), len(self.languages)))
        for lo, at, by_size in grams(column):
            n_docs = len(at) - 1
            count = np.zeros(n_docs)
            for n, h in zip(SIZES, by_size, strict=True):
                a = np.minimum(at[:-1], len(h))
                z = np.clip(at[1:] - n + 1, a, len(h))
                count += z - a
                for c in range(len(self.languages)):
                    sums = np.concatenate(([0.0], np.cumsum(self.table[c][h], dtype=np.float64)))
                    out[lo : lo + n_docs, c] += sums[z] - sums[a]
            out[lo : lo + n_docs] /= np.maximum(count, 1)[:, None]
        return out + self.shift


def _epoch(rows, target, emb, out, bias, order, rate, batch=32):
    for i in range(0, len(order), batch):
        part = order[i : i + batch]
        ids = np.concatenate([rows[j][0] for j in part])
        share = np.concatenate([rows[j][1] for j in part])
        sizes = np.array([len(rows[j][0]) for j in part])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        text = np.add.reduceat(emb[ids] * share[:, None], starts, axis=0)
        z = text @ out + bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = z / z.sum(axis=1, keepdims=True)
        error[np.arange(len(part)), target[part]] -= 1
        back = error @ out.T
        out -= rate * text.T @ error / len(part)
        bias -= rate * error.mean(axis=0)
        np.add.at(emb, ids, -rate * share[:, None] * np.repeat(back, sizes, axis=0))


def _fit_temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least log loss on a grid of powers."""

    def loss(t):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), target]))

    return min(np.exp2(np.arange(-4, 4.01, 0.25)), key=loss)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], size: int = 16, epochs: int = 6, rate: float = 4.0, seed: int = 3) -> Model:
    """``rows``: buckets and counts. A fifth of the rows calibrates. Without rows there is no
    language to predict and every text is undetermined; with one language its score is 1."""
    languages = sorted(set(labels))
    target = np.array([languages.index(x) for x in labels], dtype=int)
    rng = np.random.default_rng(seed)
    shares = [(ids, (n / max(1, n.sum())).astype(np.float32)) for ids, n in rows]
    use = np.array([i for i, (ids, _) in enumerate(rows) if len(ids)], dtype=int)
    order = rng.permutation(use)
    held, order = order[::5], np.setdiff1d(order, order[::5])
    emb = rng.normal(0, 0.1, (BUCKETS, size)).astype(np.float32)
    out = rng.normal(0, 0.1, (size, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    for e in range(epochs if len(order) else 0):
        _epoch(shares, target, emb, out, bias, rng.permutation(order), rate * (1 - e / epochs))
    model = Model(languages, np.ascontiguousarray((emb @ out).T), bias, 1.0, 0.0)
    if len(held) and len(languages) > 1:
        logits = np.array([model.table[:, shares[i][0]] @ shares[i][1] for i in held]) + bias
        model.temperature = float(_fit_temperature(logits, target[held]))
        best = model.probabilities(logits)
        right, score = best.argmax(axis=1) == target[held], best.max(axis=1)
        by_score = np.argsort(-score)
        precise = np.cumsum(right[by_score]) / np.arange(1, len(held) + 1) >= PRECISION
        model.least = float(score[by_score][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return model


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE_ROWS) -> Model:
    """Fits on about ``most`` rows of ``docs`` with a text and a label, each with all of its n-grams, or on fewer where these could take more
    than ``SAMPLE_BYTES`` (6 bytes an n-gram; a byte begins one of each size)."""
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    sample = bounded(labelled, "_key", most)
    room = sample.agg(F.sum(6 * F.least(len(SIZES) * F.octet_length("_text"), F.lit(BUCKETS)))).first()[0] or 0
    if room > SAMPLE_BYTES:
        sample = bounded(labelled, "_key", max(1, sample.count() * SAMPLE_BYTES // room))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for _, at, by_size in grams(batch.column("_text")):
                for d in range(len(at) - 1):
                    found = np.bincount(np.concatenate([h[_own(at, d, n)] for n, h in zip(SIZES, by_size, strict=True)]), minlength=BUCKETS)
                    some = np.flatnonzero(found)
                    ids.append(some.astype(np.uint16).tobytes())
                    counts.append(found[some].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_key").cast(pa.string()), batch.column("_lang"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["k", "lang", "ids", "counts"])

    got = sample.mapInArrow(extract, "k string, lang string, ids binary, counts binary").collect()
    got.sort(key=lambda r: (len(r.k), r.k, bytes(r.ids)))
    return fit([(np.frombuffer(bytes(r.ids), np.uint16).astype(np.int64), np.frombuffer(bytes(r.counts), np.float32)) for r in got], [r.lang for r in got])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``accepted`` (these replace columns so named).

    A null text, or one without any letter, is ``und`` with score 0 and not accepted. Other texts get a learned language, its calibrated
    probability, and whether that reaches the score below which predictions are rejected. Equal
    texts, of whatever length, get equal results; repeated rows stay; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    got, letter = fresh("_got", columns), fresh("_letter", columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages weights

    @F.arrow_udf("struct<best:string,score:double>")
    def judged(texts: pa.Array) -> pa.Array:
        m = shared.value
        p = m.probabilities(m.logits(texts.fill_null("")))
        return pa.StructArray.from_arrays([pa.array([m.languages[b] for b in p.argmax(axis=1)], pa.string()), pa.array(p.max(axis=1), pa.float64())], ["best", "score"])

    # The constant stands where nothing was learned; only the text goes to Python.
    named = judged(F.col(text)) if model.languages else F.struct(F.lit(None).cast("string").alias("best"), F.lit(0.0).alias("score"))
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) if model.languages else F.lit(False)
    marked = docs.select(*columns, named.alias(got), has_letter.alias(letter))
    score = F.when(F.col(letter), F.col(f"{got}.score")).otherwise(0.0)
    return marked.select(*columns, F.when(F.col(letter), F.col(f"{got}.best")).otherwise(UNDETERMINED).alias("lang_pred"), score.alias("score"), (F.col(letter) & (score >= model.least)).alias("accepted"))


def op3_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "accepted")
