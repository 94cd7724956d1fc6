"""Names that clash, nested and parallel blocks of written tables, rows that nothing is known against, and training rows of any length."""

import os
import random
import threading

import numpy as np
import pytest

from histoloom.llm import components, decontaminate, jaccard, language, quality
from histoloom.llm.storage import kept, scratch, written


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 20])
def test_leaks_of_keys_named_as_results(spark, block_bytes):
    docs = spark.createDataFrame([(1, 2, 3, "say the magic words now"), (1, 2, 3, None)], "spans long, items int, n_words int, text string")
    items = spark.createDataFrame([("a", "the magic words"), ("b", "now"), ("c", "not there at all")], "item_id string, text string")
    got = decontaminate.find_leaks(docs, items, ["spans", "items", "n_words"], block_bytes=block_bytes)
    assert got.columns == ["spans", "items", "n_words", "n_words_", "spans_", "items_"]
    assert sorted((r.spans, r.n_words_, [(x["start"], x["end"]) for x in r.spans_], r.items_) for r in got.collect()) == [(1, 0, [], []), (1, 5, [(1, 5)], ["a", "b"])]


def test_threads_have_blocks_of_their_own(spark):
    here, there, out = threading.Event(), threading.Event(), {}

    def other():
        with scratch():
            out["other"] = written(spark.range(3).toDF("x"), "other")
            there.set()
            assert here.wait(60)
            out["n"] = out["other"].count()

    thread = threading.Thread(target=other)
    with scratch():
        thread.start()
        assert there.wait(60)
        with scratch():
            mine, gone = kept(written(spark.range(5).toDF("x"), "mine")), written(spark.range(2).toDF("x"), "gone")
        there = lambda df: os.path.exists(df._written_path.removeprefix("file://"))
        assert there(mine) and there(out["other"]) and not there(gone)
        here.set()
        thread.join()
        assert out["n"] == 3 and not there(out["other"]) and mine.count() == 5
    assert not there(mine)


def test_without_labels_all_rows_stay(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None), (None, "x")], "doc_id long, text string")
    for rows in ([], [(1, 0, 1)], [(1, 1, 0), (2, 0, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert quality.accepted(docs, labels).count() == 3


def test_training_rows_give_all_their_n_grams(spark, monkeypatch):
    r = random.Random(2)
    long = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30_000))
    docs = spark.createDataFrame([(i, long if i % 2 else f"kurz und gut {i}", "en" if i % 2 else "de") for i in range(20)], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "fit", lambda rows, labels: seen.append((rows, labels)))
    language.train(docs)
    rows, labels = seen.pop()
    most = max(len(ids) for ids, _ in rows)
    assert len(rows) == 20 and most > 5000 and all(n.min() >= 1 and len(np.unique(ids)) == len(ids) for ids, n in rows)
    assert {int(n.sum()) for (_, n), lang in zip(rows, labels, strict=True) if lang == "en"} == {3 * len(long.encode()) - 6}
    monkeypatch.setattr(language, "SAMPLE_BYTES", 6 * 32768 * 5)  # room for five of the long ones
    language.train(docs)
    assert 0 < len(seen.pop()[0]) < 15


@pytest.mark.parametrize("chunk", [components.CHUNK_EDGES, 3])
def test_components_of_a_group_in_many_parts(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK_EDGES", chunk)
    edges = [(i, i % 7) for i in range(7, 120)] + [(500 + i, 501 + i) for i in range(20)] + [(900, 900), (None, 3), (5, 7), (7, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(9)).collect()}
    expected = {i: i % 7 for i in range(120)} | {500 + i: 500 for i in range(21)}
    for i in range(120):  # 5 and 7 are one, so the classes of 0 and 5 are
        expected[i] = 0 if i % 7 in (0, 5) else i % 7
    assert got == expected


def test_trees_link_as_plain_pairs_do():
    r = np.random.default_rng(7)
    for size in (3, 40, 300):
        base = [np.unique(r.integers(0, 1 << 62, size).astype(np.uint64)) for _ in range(6)]
        sets = [np.unique(np.concatenate((b[r.random(len(b)) < 0.93], r.integers(0, 1 << 62, r.integers(0, 4)).astype(np.uint64)))) for b in base for _ in range(9)]
        sets = [x for x in sets if len(x)]
        label = list(range(len(sets)))
        label[3] = label[17]
        expected = list(label)
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = expected[i], expected[j]
                    expected = [min(a, b) if x in (a, b) else x for x in expected]
        assert jaccard.link_group(sets, label, [False] * len(sets)) == expected
