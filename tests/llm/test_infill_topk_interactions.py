"""Fill-in-middle, top-k search and the filter audit against plain versions, with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from compare import SMALL, duck, rows
from pyspark.sql import functions as F

from histoloom.llm import catalog, infill, interactions, topk

NEW = ["op11_fenwick_infill", "op12_histogram_topk", "op13_filter_interactions"]


@pytest.mark.parametrize("name", NEW)
def test_equals_sql(spark, name):
    ours, theirs = catalog.queries()[name](spark, SMALL).toPandas(), duck(SMALL).execute(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


# ---- fill in the middle


def test_fenwick_sums_and_cuts():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("ab\n\né漢\U0001f600") for _ in range(r.randint(0, 80)))
        raw, units = text.encode(), re.findall(r"[^\n]*\n|[^\n]+", text)
        found = infill.Blocks(np.frombuffer(raw, dtype=np.uint8), r.randint(1, 12))
        assert (found.lines, found.points) == (len(units), len(text))
        for k in range(-1, len(units) + 2):
            head = "".join(units[: max(k, 0)])
            assert found.cut(k) == (len(head.encode()), len(head))
    counts = np.array([r.randint(0, 9) for _ in range(37)])
    tree = infill.fenwick(counts)
    for i in range(38):
        at, total = i, 0
        while at:
            total, at = total + tree[at], at & (at - 1)
        assert total == counts[:i].sum()


def plain_infill(key, text, rate=100, spm=50, seed=7, marks=infill.MARKS):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    head, middle, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if h4 % 100 < spm:
        return len(units), "spm", len(head), len(middle), s + tail + p + head + m + middle
    return len(units), "psm", len(head), len(middle), p + head + s + tail + m + middle


@pytest.mark.parametrize("rate, spm, marks, block", [(100, 50, infill.MARKS, infill.BLOCK), (60, 30, ("[a.", "(*", "{|"), 5)])
def test_infill_equals_plain_version(spark, rate, spm, marks, block):
    r = random.Random(8)
    long = "\n".join(f"line {i} é漢" for i in range(400_000))  # some megabytes
    texts = [None, "", "\n", "\n\n", "one", "two\n", "a\nb\nc", "has <S> in it\nx", "<<S\n>P>\n<\n", "[a. (* \n {|", long, "x" * 3_000_000, "end\r\nof\r\n"]
    texts += ["".join(r.choice("ab<>PSM\n é\U0001f600") for _ in range(r.randint(0, 60))) for _ in range(150)]
    table = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "a\nb", 1, "x"), (4, "one", 1, "x"), (4, "one", 1, "x"), (-7, "q\nr\ns", 1, "x")]
    docs = spark.createDataFrame(table, "form long, text string, n int, output string").repartition(3)  # the key is named as an output
    made = infill.fill_in_middle(docs, "form", "text", rate, spm, 7, marks, block)
    assert made.columns == ["form", "n", "form_", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form_"), marks)).collect()
    expected = Counter((k, *plain_infill(k, t, rate, spm, 7, marks), t or "") for k, t, *_ in table)
    assert Counter(map(tuple, got)) == expected
    assert len({x.form_ for x in got}) == 3


def test_infill_refuses_marks_that_clash(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    for marks in (("<a>", "<a>", "b"), ("<", "<b", "c"), ("", "b", "c"), ("ab", "bc", "d"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs, marks=marks)
    assert infill.fill_in_middle(docs).collect() == []


# ---- exact top-k


def plain_top(table, asks, k, scale=1024):
    whole = {}
    for i, (_, v) in enumerate(table):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(scale * x) for x in v]
    out = Counter()
    for i, v in whole.items():
        key = table[i][0]
        if key is None or not asks(key):
            continue
        found = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=False)))), table[j][0] is None, table[j][0] or 0) for j, w in whole.items() if j != i]
        for rank, (score, none, other) in enumerate(sorted(found)[:k], 1):
            out[key, rank, None if none else other, -score] += 1
    return out


def vectors_of(kind, r):
    if kind == "ties":
        return [(i, [float(r.randint(-1, 1)) for _ in range(3)]) for i in range(300)]
    if kind == "wide":
        return [(i, [r.uniform(-900, 900) for _ in range(6)]) for i in range(200)]
    if kind == "huge":  # beyond what a double holds exactly, and beyond a long
        return [(i, [r.uniform(-1, 1) * 10.0 ** r.randint(0, 14) for _ in range(3)]) for i in range(80)]
    odd = [(0, None), (10, [1.0, None]), (20, [math.nan, 1.0]), (30, [math.inf, 0.0]), (40, []), (50, [2.0]), (60, [1.0, 2.0, 3.0, 4.0]), (None, [5.0, 5.0]), (70, [1.0, 1.0]), (70, [1.0, 1.0]), (70, [0.5, -1.0]), (-80, [0.0, 0.0])]
    return odd + [(7, [0.25, 0.5])] * 40 + [(i, [r.random(), r.random()]) for i in range(100, 140)]


@pytest.mark.parametrize("kind", ["ties", "wide", "huge", "odd"])
@pytest.mark.parametrize("chunk_bytes", [topk.CHUNK_BYTES, 100])
def test_top_k_equals_plain_version(spark, kind, chunk_bytes):
    table = vectors_of(kind, random.Random(kind))
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in table], "score long, embedding array<double>, row int, query string").repartition(5)
    got = topk.top_k(df, F.col("score") % 10 == 0, 7, "score", chunk_bytes=chunk_bytes)
    assert got.columns == ["query_id", "rank", "score", "score_"]
    assert Counter(map(tuple, got.collect())) == plain_top(table, lambda i: math.fmod(i, 10) == 0, 7)


def test_top_k_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(100, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(100, 1, 1, 1 << 20), (100, 2, 2, 0)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert topk.top_k(df, F.col("vec_id") < 0).collect() == []
    alone = topk.top_k(df.where("vec_id = 100"), F.col("vec_id") % 100 == 0)
    assert alone.collect() == [] and alone.columns == ["query_id", "rank", "vec_id", "score"]


def test_a_task_sends_its_highest_bins_until_they_reach_the_need():
    query, at, count = np.array([0, 0, 0, 1, 1, 0]), np.array([9, 4, 2, 0, 7, 4]), np.array([1, 1, 50, 3, 1, 2])
    got = [x.tolist() for x in topk._top_bins(query, at, count, np.array([4, 9]))]
    assert got == [[0, 0, 1, 1], [9, 4, 7, 0], [1, 3, 1, 3]]
    assert [len(x) for x in topk._top_bins(*(np.zeros(0, dtype=np.int64),) * 3, np.array([4]))] == [0, 0, 0]
    assert topk.integers(pa.array([[0.5, -0.0001], [1.0], []]), 1024, 2).tolist() == [[512.0, -1.0], [1024.0, 0.0], [0.0, 0.0]]


# ---- interactions of filters


def plain_audit(table, labels):
    """Counter of the audit's rows; table: (id, text, part), labels: (id, quality, toxic)."""
    good, bad = ({i for i, *v in labels if i is not None and v[at] == 1} for at in (0, 1))
    docs = []
    for key, text, part in table:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = key is not None and any((t or "") == text and k is not None and k < key for k, t, _ in table)
        docs.append((part or "", {c for c, f in fails.items() if f}, key in good, key in bad))
    out = set()
    for part in {d[0] for d in docs}:
        mine, found, shapley = [d for d in docs if d[0] == part], [], Counter()
        for order in permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                gone = {*order[: step - 1]}
                lost = [d for d in mine if c in d[1] and not d[1] & gone]
                shapley[c] += len(lost)
                found.append((c, (part, "".join(order), step, sum(not d[1] & (gone | {c}) for d in mine), len(lost), sum(c in d[1] and bool(d[1] & gone) for d in mine), sum(d[1] == {c} for d in mine), sum(d[2] for d in lost), sum(d[3] for d in lost))))
        out |= {(*row, shapley[c]) for c, row in found}
    return out


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("hot, hashes", [(interactions.HOT_COPIES, interactions.BROADCAST_HASHES), (3, 0)])
def test_audit_equals_plain_version(spark, monkeypatch, hot, hashes):
    monkeypatch.setattr(interactions, "HOT_COPIES", hot)
    monkeypatch.setattr(interactions, "BROADCAST_HASHES", hashes)
    r = random.Random(5)
    many = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "   ", many, many, many.upper(), many + " #", " ".join(["same", "word"] * 150), "x " * 1_500_000, "Éa\x00b\x0bc"]
    table = [(i, t, r.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    table += [(r.randint(100, 130), r.choice([many, "few | words", None, many + " tail"]), "en") for _ in range(60)]
    table += [(None, many, "en"), (None, many, "de"), (5, many, "en"), (5, many, "en"), (5, many, "fr")]
    labels = [(3, 1, 0), (3, 0, None), (4, None, 1), (None, 1, 1), (5, 1, 1), (110, 1, None), (111, 0, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*x, 7, "y", 2) for x in table], "doc_id long, text string, lang string, mask int, h string, quality int").repartition(4)
    told = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, n int")
    got = interactions.audit(docs, told)
    assert sorted(got.columns) == sorted(COLUMNS)
    assert {tuple(x) for x in got.select(*COLUMNS).collect()} == plain_audit(table, labels)


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(docs.limit(0), labels).count() == 0
    got = interactions.audit(docs, labels).toPandas()
    assert len(got) == 600 and set(got["part"]) == {""} and got["removed"].sum() == 120
    assert pd.unique(got.loc[got["filter_order"].str[0] == "A", "removed"]).tolist() in ([1, 0], [0, 1])
