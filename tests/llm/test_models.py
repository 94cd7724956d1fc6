"""The classifiers against plain recomputations on small tables, and packing against exact search."""

import itertools
import math
import re
import zlib

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from histoloom.llm import language, packing, quality

TEXTS = ["The cat sat on the mat, quietly.", "win $$$ now!!! click click click here", "", "A", "über größe straße ok", "One. Two. Three? Four!", "buy now now now", "12 34 56"]


def plain_indicators(text):
    """Byte trigrams and runs of word shapes, hashed one at a time."""
    data, out, mask = text.encode(), set(), (1 << 32) - 1
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        h = (a * 0x9E3779B1 & mask) ^ (b * 0x85EBCA77 & mask)
        out.add(((h + c * 0xC2B2AE3D & mask) * 0x27D4EB2F & mask) >> 16)
    kind = lambda x: 0 if 97 <= x < 123 else 1 if 65 <= x < 91 else 2 if 48 <= x < 58 else 3 if x >= 128 else 5 + b".,!?|#$%&*:;/@-_'\"".index(x) if x in b".,!?|#$%&*:;/@-_'\"" else 4
    words, shapes = [m.encode() for m in brute.SPACED.findall(text)], []
    folded = [m.translate(brute.LOWER) for m in brute.SPACED.findall(text)]
    for i, w in enumerate(words):
        lag = next((d for d in range(1, 9) if i >= d and folded[i - d] == folded[i]), 0)
        shapes.append(((kind(w[0]) * 32 + kind(w[max(len(w) - 2, 0)])) * 32 + kind(w[-1])) * 256 + min(len(w), 12) * 16 + lag)
    full = (1 << 64) - 1

    def mix(h):
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & full
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) & full
        return h ^ h >> 31

    for n in (1, 2, 3):
        for i in range(len(shapes) - n + 1):
            h = 0
            for s in shapes[i : i + n]:
                h = (h * 0x100000001B3 + s + n) & full
            out.add((mix(h) >> 49) + (1 << 16))
    return sorted(out)


def test_indicators():
    assert [x.tolist() for x in quality.indicators(pa.array(TEXTS))] == [plain_indicators(t) for t in TEXTS]


def test_packed_indicators_come_back():
    for n in (0, 1, 50, quality.FEATURES // 32 - 1, quality.FEATURES // 32, 40_000):
        found = np.sort(np.random.default_rng(n).choice(quality.FEATURES, n, replace=False))
        row = quality.packed(found)
        assert len(row) <= quality.FEATURES // 8 and quality.unpacked(row).tolist() == found.tolist()


def test_ratios_dual_optimum_and_interpolation():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 30, r.integers(1, 12))) if i % 2 else np.unique(r.integers(15, 45, r.integers(1, 12))) for i in range(60)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(60)])
    rows = [quality.packed(x) for x in sets]
    ratio, used = quality.log_ratios(rows, (y > 0).astype(int), 1.0)
    for f in (0, 20, 44, 100):
        p, q = 1 + sum(f in x for x, s in zip(sets, y, strict=True) if s > 0), 1 + sum(f in x for x, s in zip(sets, y, strict=True) if s < 0)
        n1, n0 = quality.FEATURES + sum(len(x) for x, s in zip(sets, y, strict=True) if s > 0), quality.FEATURES + sum(len(x) for x, s in zip(sets, y, strict=True) if s < 0)
        assert math.isclose(ratio[f], math.log(p / n1) - math.log(q / n0)) and used[f] == any(f in x for x in sets)
    # Dual and primal objectives meet at the optimum.
    cost = np.where(y > 0, 0.7, 1.3)
    weight = quality._dual_descent(rows, y, ratio, cost, 400, np.random.default_rng(1))
    scaled = [ratio[x] / np.linalg.norm(ratio[x]) for x in sets]
    slack = np.array([1 - s * (v @ weight[x]) for s, v, x in zip(y, scaled, sets, strict=True)])
    primal = 0.5 * weight @ weight + (cost * np.maximum(slack, 0)).sum()
    best = min(0.5 * w @ w + (cost * np.maximum([1 - s * (v @ w[x]) for s, v, x in zip(y, scaled, sets, strict=True)], 0)).sum() for w in (weight * k for k in (0.9, 0.97, 1.03, 1.1)))
    assert primal <= best + 1e-9
    assert weight[~used].tolist() == [0.0] * int((~used).sum())
    mixed = quality.interpolated(weight, used, 0.25)
    mean = np.abs(weight[used]).mean()
    assert np.allclose(mixed[used], 0.25 * weight[used] + 0.75 * mean) and not mixed[~used].any()
    assert np.allclose(quality.interpolated(weight, used, 1.0), weight)


def test_sigmoid_maximises_the_likelihood():
    r = np.random.default_rng(4)
    margin = r.normal(0, 1, 300)
    label = (r.random(300) < 1 / (1 + np.exp(-3 * margin + 0.5))).astype(int)
    slope, shift = quality._sigmoid_fit(margin, label)
    n1, n0 = label.sum(), 300 - label.sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(a, b):
        z = a * margin + b
        return (np.log1p(np.exp(z)) - target * z).sum() + 5e-4 * (a * a + b * b)

    assert all(loss(slope, shift) <= loss(slope + a, shift + b) + 1e-9 for a, b in itertools.product((-0.05, 0, 0.05), repeat=2))


def test_calibration_rows_take_no_part_in_the_model():
    rows = [quality.packed(np.array([i % 7, 10 + i % 3])) for i in range(40)]
    labels = np.array([i % 2 for i in range(40)])
    held = np.zeros(40, dtype=bool)
    rng = np.random.default_rng(5)
    for c in (0, 1):
        held[rng.permutation(np.flatnonzero(labels == c))[::5]] = True
    other = [quality.packed(np.array([500 + i])) if held[i] else x for i, x in enumerate(rows)]
    a, b = quality.fit(rows, labels), quality.fit(other, labels)
    assert np.array_equal(a.ratio, b.ratio) and np.array_equal(a.weight, b.weight)


def plain_grams(text):
    data = bytes(c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or c >= 128 else 32 for c in text.encode())
    out = []
    for n in language.SIZES:
        for i in range(len(data) - n + 1):
            h = n
            for c in data[i : i + n]:
                h = (h * 0x01000193 + c) & 0xFFFFFFFF
            out.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> 17)
    return out


def test_logits_are_mean_embeddings_through_the_layer():
    r = np.random.default_rng(8)
    emb, layer, bias = r.normal(size=(language.BUCKETS, 4)), r.normal(size=(4, 3)), r.normal(size=3)
    model = language.Model(["a", "b", "c"], np.ascontiguousarray((emb @ layer).T).astype(np.float32), bias, 2.0, 0.5)
    got = model.logits(pa.array(TEXTS))
    for row, text in zip(got, TEXTS, strict=True):
        grams = plain_grams(text)
        mean = emb[grams].mean(axis=0) if grams else np.zeros(4)
        assert np.allclose(row, mean @ layer + bias, atol=1e-4)
    p = model.probabilities(got)
    assert np.allclose(p, np.exp(got / 2) / np.exp(got / 2).sum(axis=1, keepdims=True))


def test_one_gradient_step_and_temperature():
    r = np.random.default_rng(3)
    emb, out, bias = (r.normal(0, 0.1, s) for s in ((language.BUCKETS, 3), (3, 2), (2,)))
    rows = [(np.array([1, 5, 9]), np.array([0.5, 0.25, 0.25])), (np.array([2, 5]), np.array([0.5, 0.5]))]
    target = np.array([0, 1])

    def loss(e, o, b):
        z = np.array([(e[i] * s[:, None]).sum(axis=0) @ o + b for i, s in rows])
        return float((np.log(np.exp(z).sum(axis=1)) - z[[0, 1], target]).sum())

    before = emb.copy(), out.copy(), bias.copy()
    language._epoch(rows, target, emb, out, bias, np.array([0, 1]), 0.1)
    eps = 1e-6
    for at in ((1, 0), (5, 2), (7, 1)):
        e = before[0].copy()
        e[at] += eps
        assert math.isclose(emb[at] - before[0][at], -0.1 * (loss(e, *before[1:]) - loss(*before)) / eps, abs_tol=1e-5)
    o = before[1].copy()
    o[2, 1] += eps
    assert math.isclose(out[2, 1] - before[1][2, 1], -0.1 * (loss(before[0], o, before[2]) - loss(*before)) / eps / 2, abs_tol=1e-5)
    logits = r.normal(0, 5, (50, 2))
    labels = r.integers(0, 2, 50)
    t = language._fit_temperature(logits, labels)
    nll = lambda x: float((np.log(np.exp(logits / x).sum(axis=1)) - (logits / x)[np.arange(50), labels]).mean())
    assert all(nll(t) <= nll(x) + 1e-12 for x in np.exp2(np.arange(-4, 4.01, 0.25)))


def test_training_uses_only_the_other_folds(spark):
    rows = [(i, "aaa bbb ccc" if i % 2 else "xxx yyy zzz", "a" if i % 2 else "x") for i in range(300)]
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, t, ("x" if lang == "a" else "a") if i in held else lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    from histoloom.llm.sampling import fold

    model = language.train(docs.where(fold(F.col("doc_id"), 5) != 0))
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert got == {i: lang for i, _, lang in rows}
    assert spark.range(1).select((fold(F.lit(None).cast("long"), 5) == 0).alias("h")).first().h is False


def fewest_bins(lengths, capacity):
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in sorted({x for x in bins if x + lengths[i] <= capacity}):
            rest = list(bins)
            rest[rest.index(b)] += lengths[i]
            place(i + 1, rest)
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def test_certificates_against_exact_search(spark):
    r = np.random.default_rng(6)
    rows, exact = [], {}
    for part in range(40):
        lengths = sorted(r.integers(1, 21, r.integers(3, 9)).tolist(), reverse=True)
        exact[part] = fewest_bins(lengths, 20)
        assert packing.lower_bound(np.array(lengths), 20) <= exact[part] <= len(packing.best_fit_decreasing(np.array(lengths), 20)[2])
        rows += [(len(rows) + j, 0, n, part) for j, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, part long")
    got = packing.pack(pieces, 20).toPandas()
    assert len(got) == len(rows) and (got.groupby("sequence_id").length.sum() <= 20).all()
    assert got.sequence_id.nunique() <= sum(exact.values())
    assert ((got.part_bins == got.part_bound) == got.certified).all() and got.part_bins.ge(got.part_bound).all()
    by_first = got[got.part < 40].drop_duplicates("part")
    assert (by_first[by_first.certified].part_bins == by_first[by_first.certified].part.map(exact)).all()


def test_labels_of_repeated_keys(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model.slope == 0.0 and math.isclose(model.score(np.array([1])), 1 / 3)
    assert re.match(r"\d", str(pd.Series([model.shift])[0])) or model.shift < 0
