"""The pipeline, stage by stage, against plain versions."""

import brute
import corpus_pipeline as pipeline
import pandas as pd
from pyspark.sql import functions as F

from histoloom.llm.storage import written

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = pd.read_parquet(f"{DIR}/benchmark.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.orderBy("doc_id").toPandas()
        docs = written(stage(spark, docs, DIR), name)
        after = docs.orderBy("doc_id").toPandas()
        assert docs.columns == COLUMNS
        pairs = list(zip(before.doc_id, before.text, strict=True))
        if name == "quality":
            labels = pd.read_parquet(f"{DIR}/labels.parquet").set_index("doc_id").quality
            kept = before.doc_id.isin(after.doc_id)
            known = before.doc_id.isin(labels.index)
            assert (kept[known].to_numpy() == (labels.loc[before.doc_id[known]] == 1).to_numpy()).mean() > 0.95
        elif name == "near_copies":
            expected = brute.components(pairs)
            assert after.doc_id.tolist() == [i for i, _ in pairs if expected[i][1] == i]
        elif name == "repeats":
            expected = {i: t for (i, _), (_, _, t) in zip(pairs, brute.repeats(pairs), strict=True)}
            assert dict(zip(after.doc_id, after.text, strict=True)) == {i: t for i, t in expected.items() if brute.SPACED.search(t)}
        else:
            found = brute.leaks(before.text, list(zip(items.item_id, items.text, strict=True)))
            assert after.doc_id.tolist() == [i for i, (n, hit, _) in zip(before.doc_id, found, strict=True) if len(hit) <= 0.8 * n]
            assert not any(hit for _, hit, _ in brute.leaks(after.text, list(zip(items.item_id, items.text, strict=True))))
        assert (after.n_chars == after.text.str.len()).all()
    name, stage = pipeline.STAGES[-1]
    packed = stage(spark, docs, DIR)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_stages_on_odd_rows(spark, odd, odd_dir, tmp_path):
    """Null and empty texts, null, repeated and shared keys: what stays after each stage, with labels that accept all rows."""
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"file://{odd_dir}/{t}.parquet").write.parquet(f"file://{tmp_path}/{t}.parquet")
    spark.createDataFrame([(i, 1) for i in range(1, 13)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs, folder = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), f"file://{tmp_path}"
    stages = dict(pipeline.STAGES)
    rows = lambda df: sorted(((r.doc_id if r.doc_id is not None else 1 << 62, r.text) for r in df.collect()), key=lambda x: (x[0], x[1] or ""))
    docs = written(stages["quality"](spark, docs, folder), "quality")
    assert rows(docs) == rows(odd)
    docs = written(stages["near_copies"](spark, docs, folder), "near")
    kept = [1, 3, 4, 5, 6, 8, 10, 11, 12, 14, 15, 15, 1 << 62]
    assert [i for i, _ in rows(docs)] == kept
    before = rows(docs)
    docs = written(stages["repeats"](spark, docs, folder), "repeats")
    expected = sorted(((i, t) for (i, _), (_, _, t) in zip(before, brute.repeats(before), strict=True)), key=lambda x: (x[0], x[1] or ""))
    assert rows(docs) == expected and expected[9][1].split() == ["loop"]  # of the loop its first turn stays
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = brute.leaks([t for _, t in expected], items)
    docs = written(stages["benchmark"](spark, docs, folder), "benchmark")
    left = [i for (i, _), (n, hit, _) in zip(expected, found, strict=True) if len(hit) <= 0.8 * n]
    assert [i for i, _ in rows(docs)] == left and 6 not in left and {3, 4, 5, 10, 12, 1 << 62} <= set(left)
    packed = stages["packing"](spark, docs, folder)
    assert {r.doc_id if r.doc_id is not None else 1 << 62 for r in packed.collect()} == set(left)


def test_run_on_odd_and_empty_rows(spark, odd_dir, empty_dir):
    # Two labels are too few to learn from, so no row is rejected.
    assert pipeline.run(spark, odd_dir).select("doc_id").distinct().count() >= 10
    assert pipeline.run(spark, empty_dir).count() == 0
