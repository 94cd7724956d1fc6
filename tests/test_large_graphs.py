"""What the graphs over large tables move and leave on disk, and coalitions scored in batches."""

import os

import numpy as np
import pytest
from histoloom.functions.shared import dealt, scratch_path, with_global_rank, written
from histoloom.operators import assembly, attribution, audits, graphs, history_graph
from histoloom.plans import views
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_tables_are_not_dealt_again(spark):
    rows = spark.range(1000).select((F.col("id") % 50).cast("string").alias("hash"), (F.col("id") % 7).alias("f"), "id")
    left, right = written(dealt(rows, "hash"), "left"), written(dealt(rows.withColumnRenamed("hash", "commit_hash"), "commit_hash"), "right")
    sums = right.groupBy(F.col("commit_hash").alias("hash"), "f").agg(F.sum("id").alias("s"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = left.join(sums, ["hash", "f"])
        assert "Exchange" not in plan(both)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(both.collect()) == sorted(rows.join(rows.groupBy("hash", "f").agg(F.sum("id").alias("s")), ["hash", "f"]).collect())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("histoloom")]


def test_written_tables_leave_no_shuffle_files(spark):
    def shuffled():
        folder = spark.conf.get("spark.local.dir")
        return {f for _, _, names in os.walk(folder) for f in names if f.startswith("shuffle_")}

    before = shuffled()
    written(spark.range(1000).groupBy((F.col("id") % 9).alias("k")).count(), "groups")
    assert not shuffled() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_sizes_are_counted_before_rows_move(spark):
    nodes = spark.createDataFrame([("a", "file"), ("b", "file"), ("b", "commit")], "hash string, type string")
    edges = spark.createDataFrame([("a", "has"), ("b", "has")], "hash string, rel string")
    totals = graphs.graph_totals(nodes, edges)
    assert sorted(map(tuple, totals.collect())) == [("edge", "has", 2), ("node", "commit", 1), ("node", "file", 2)]
    assert not [x for x in plan(totals).splitlines() if "Exchange" in x and "hash#" in x]


def test_views_by_commit_equal_views(spark):
    """Lines without a part, a part that stands twice, lines and orders without a key."""
    folder, small = scratch_path(spark, "odd"), "/root/testdata/sf0.001"
    read = lambda t: spark.read.parquet(f"{small}/{t}.parquet")
    parts, lines, orders = read("part"), read("lineitem"), read("orders")
    parts = parts.where("p_partkey % 5 <> 0").unionByName(parts.where("p_partkey % 7 = 0"))
    lines = lines.withColumn("l_partkey", F.when(F.col("l_linenumber") < 4, F.col("l_partkey"))).withColumn("l_orderkey", F.when(F.col("l_suppkey") > 1, F.col("l_orderkey")))
    for name, df in (("part", parts), ("lineitem", lines), ("orders", orders), ("customer", read("customer")), ("nation", read("nation"))):
        df.write.parquet(f"{folder}/{name}.parquet")
    names = [v for v in views.VIEWS if v not in ("fx_scores", "fx_runs")]
    there = views.tables_by_commit(spark, folder, names)
    round_ = lambda df: df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    for name in names:
        found, wanted = round_(there[name]), round_(views.table(spark, folder, name))
        assert found.columns == wanted.columns
        assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty(), name


def test_coalitions_scored_in_batches(spark):
    drawn = attribution.sampled_coalitions(5, 12)
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("b", 0.0, 0.0), ("c", None, 1.0)], "hash string, p double, q double")
    score = lambda x, has: x[:, [0]] * has[:, 0] + x[:, [1]] * has[:, 1] * has[:, 2]
    got = {(r.hash, r.player): r.phi for r in attribution.kernel_shap_batches(rows, ["p", "q"], score, drawn, 5).collect()}
    masks = attribution.coalition_table(spark, drawn).select("mask")
    bit = lambda i: F.shiftright("mask", i).bitwiseAND(1)
    scores = rows.crossJoin(masks).select("hash", "mask", (F.col("p") * bit(0) + F.col("q") * bit(1) * bit(2)).alias("prob"))
    wanted = {(r.hash, r.player): r.phi for r in attribution.kernel_shap(scores, drawn, 5).collect()}
    assert got.keys() == wanted.keys() and all(got["c", i] is None for i in range(5))
    for key in got:
        assert got[key] == (wanted[key] if wanted[key] is None else pytest.approx(wanted[key], abs=1e-9))
    assert np.isclose(sum(got["a", i] for i in range(5)), 3.0)


def test_ranks_move_rows_once(spark):
    rows = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v int").repartition(5)
    ranked = with_global_rank(rows, [F.col("v")])
    assert "row_number" not in plan(ranked)
    assert {(r.v, r["rank"], r.total) for r in ranked.collect()} == {(i, i + 1, 101) for i in range(101)}


def test_errors_read_only_the_relations_they_count(spark):
    ends = lambda rel: spark.range(3).select(F.col("id").cast("string").alias("hash"), F.lit(rel).alias("rel"))
    commits = spark.range(4).select(F.col("id").cast("string").alias("hash"))
    nodes = commits.where("hash <> '2'").select("hash", F.lit("developer").alias("type"))
    found = audits.graph_errors(nodes, ends("authored_by").unionByName(ends("there")).unionByName(ends("owns")), commits, {}, {"there": "back"})
    assert "owns" not in plan(found)
    assert {r.hash: r.errors for r in found.collect()} == {"0": "back_there", "1": "back_there", "2": "missing_graph,no_developer,back_there", "3": "no_author_edge"}


def test_modes_keep_what_their_nodes_are_made_of(spark):
    entities = lambda key: spark.createDataFrame([("a", "b", "x", 1.0), ("a", None, "y", 2.0)], f"fc_hash string, vcc_hash string, {key} string, votes double")
    tables = {"issue_info": entities("issue_id"), "pull_request_info": entities("pr_id"), "release_tag_info": entities("tag_id")}
    commits, kinds = spark.createDataFrame([("a",), ("b",), ("c",)], "hash string"), ("issue", "pull_request", "release_tag")
    of = lambda mode: assembly._process_entities(tables, commits, mode, kinds, dict.fromkeys(kinds))
    assert {k: t.columns for k, t in of(1).items()} == {"issue": ["hash", "issue_id", "votes"], "pull_request": ["hash", "pr_id", "votes"], "release_tag": ["hash", "tag_id", "votes"]}
    assert {k: t.columns for k, t in of(2).items()} == dict.fromkeys(kinds, ["hash"])
    assert of(3)["release_tag"].columns == ["hash", "tag_id", "votes"]
    assert sorted(of(4)) == ["issue", "pull_request"] and sorted(r.hash for r in of(4)["issue"].collect()) == ["a", "b"]


def test_evolution_that_is_read_twice_is_written(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(history_graph, "written", lambda df, label: asked.update({label: df._dealt_by}) or df)
    files = spark.createDataFrame([], "hash string, filename string, complexity int")
    functions = spark.createDataFrame([], "hash string, filename string, name string, start_line int, complexity int, before_change boolean, function_change_type string")
    commits = spark.createDataFrame([], "hash string, repo_url string, author_date timestamp, commit_type string")
    fixes = spark.createDataFrame([], "vcc_hash string, fc_hash string")
    history_graph.file_edges(files, commits, fixes)
    history_graph.function_edges(functions, commits, fixes)
    assert asked == {"file-evolution": ("src",), "function-evolution": ("src",)}
