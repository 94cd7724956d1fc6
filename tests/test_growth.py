"""Steps whose cost per row decided how large queries grew, and number texts."""

from histoloom.functions import vectors
from histoloom.operators import cleaning, graphs, runs, scaling
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_result_texts_round_as_printf(spark):
    rows = [("a", 0.0005, 0.0005, 2), ("b", 1234.5, 0.0, 1), ("c", None, None, 0)]
    got = runs.result_text(spark.createDataFrame(rows, "run string, mean double, std double, n long"), 3)
    assert {r.run: r.result for r in got.collect()} == {"a": "0.001 ±0.001", "b": "1234.500", "c": None}


def test_neighbours_meet_in_plain_columns(spark):
    x = [float(i) for i in range(19)]
    nodes = spark.createDataFrame([("h", "file", "a", x), ("h", "file", "b", [2.0, None]), ("h", "file", "c", []), ("h", "file", "d", None)], "hash string, type string, node_key string, x array<double>")
    edges = spark.createDataFrame([("h", r, "file", k, "commit", "h") for r in ("r", "s") for k in "abcd" if (r, k) != ("s", "b")], "hash string, rel string, src_type string, src_key string, dst_type string, dst_key string")
    long = graphs.neighbour_means(nodes, edges)
    assert "ObjectHashAggregate" not in plan(long) and "SortAggregate" not in plan(long)
    want = [1.0 + 0.0, 1.0 + 1.0, *[2 * v for v in x[2:]]]
    assert [r.value for r in long.orderBy("dim").collect()] == want
    assert [r.x for r in graphs.neighbour_vectors(nodes, edges).collect()] == [want]


def test_masks_are_put_in_by_stretches(spark):
    rows = spark.createDataFrame([("t", [1.0] * 6), ("t", [1.0, 1.0]), ("t", None), ("u", [1.0, 1.0])], "type string, x array<double>")
    mask = scaling.mask_table(spark, [("t", 1, 2), ("t", -3, -2), ("t", 9, 12), ("t", 5, 30)])
    masked = scaling.apply_mask(rows, mask)
    assert "exists(" not in plan(masked)
    assert sorted((r.type, r.x) for r in masked.where("x IS NOT NULL").collect()) == [("t", [1.0, 0.0]), ("t", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), ("u", [1.0, 1.0])]


def test_masks_are_laid_over_one_count(spark):
    rows = spark.createDataFrame([("t", [1.0, 0.0, 3.0]), ("t", [1.0]), ("u", [2.0])], "type string, x array<double>")
    masks = {"head": scaling.mask_table(spark, [("t", 0, 0)]), "tail": scaling.mask_table(spark, [("t", -1, -1), ("t", -2, -2)]), "none": scaling.mask_table(spark, [])}
    got = {(r["mask"], r["type"], r["dim"]): r["n"] for r in scaling.values_left(rows, masks).collect()}
    assert got == {(m, t, d): n for m, left in (("head", (0, 0, 1)), ("tail", (1, 0, 0)), ("none", (2, 0, 1))) for t, d, n in (("t", 0, left[0]), ("t", 1, left[1]), ("t", 2, left[2]), ("u", 0, 1))}


def test_rare_repeats_are_not_sorted_twice(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z")], "k string, o int, v string")
    first = cleaning.keep_first(rows, ["k"], ["o"], rare=True)
    assert {(r.k, r.v) for r in first.collect()} == {("a", "y"), ("b", "z")}
    assert "WindowGroupLimit" not in plan(first)


def test_snapshots_evolve_by_their_own_dates(spark):
    from histoloom.operators import history

    rows = spark.createDataFrame([("a", "f", 1, "r", 0), ("b", "f", 3, "r", 1), ("b", "f", 5, "fork", 1), ("c", "f", 9, "fork", None)], "hash string, filename string, complexity int, repo_url string, day int")
    rows = rows.withColumn("author_date", F.timestamp_seconds(F.col("day") * 86400)).drop("day")
    found = history.file_evolution(rows, None)
    assert {(r.repo_url, r.src, r.dst) for r in found.collect()} == {("r", "a", "b"), ("fork", "c", "b")}
    assert "Join" not in plan(found)


def test_moments_are_plain_columns(spark):
    rows = spark.createDataFrame([("k", [1.0] * 9 + [2.0]), ("k", [3.0]), ("k", []), ("k", None)], "k string, x array<double>")
    found = vectors.vector_moments(rows, ["k"])
    assert "ObjectHashAggregate" not in plan(found)
    got = {r.dim: (r.n, r.mean, r.variance) for r in found.collect()}
    assert got == {0: (2, 2.0, 1.0), **{d: (1, 1.0, 0.0) for d in range(1, 9)}, 9: (1, 2.0, 0.0)}


def test_views_read_often_are_written(spark, monkeypatch):
    from histoloom.plans import assembly, graph

    asked = []
    for module in (assembly, graph):
        monkeypatch.setattr(module, "written_together", lambda tables: asked.append({k: t.columns for k, t in tables.items()}) or tables)
    pulls = spark.createDataFrame([], "pr_id string, fc_hash string, vcc_hash string, linked_issue_id string, title string, additions double")
    issues = spark.createDataFrame([], "issue_id string, fc_hash string, vcc_hash string, votes double")
    graph._references(pulls, issues, spark.createDataFrame([], "hash string"))
    assert asked.pop() == {"pulls": ["hash", "pr_id", "linked_issue_id", "title"], "issues": ["hash", "issue_id"]}
    list(assembly._stored(pulls, issues))
    assert list(asked.pop()) == ["commits", "files"]
