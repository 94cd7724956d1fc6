"""What large queries move and write: ids in place of vectors, and only the views that are read more than once."""

from histoloom.operators import nodes


def test_vectors_by_id_equal_vectors_by_key(spark):
    functions = spark.createDataFrame([("h", "f", n, 1, 2) for n in ("a", "b", "c")], "hash string, filename string, name string, start_line int, complexity int")
    refs = spark.createDataFrame([("h", "a", "f", 1, 0), ("h", "a", "f", 2, 1), ("h", "b", "f", 9, 0)], "hash string, name string, filename string, vec_id long, seq int")
    vectors = spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 3.0])], "vec_id long, emb array<double>")
    got = {r.node_key: r.x[8:] for r in nodes.function_nodes(functions, refs, 2, vectors).collect()}
    assert got == {"f::a": [2.0, 3.0], "f::b": [0.0, 0.0], "f::c": [0.0, 0.0]}


def test_ends_write_only_the_views_they_read_often(spark, monkeypatch):
    from histoloom.plans import assembly

    asked = []
    monkeypatch.setattr(assembly, "written_together", lambda tables: asked.extend(tables) or tables)
    views = [spark.createDataFrame([], "hash string, commit_type string, author_date timestamp, authored_at timestamp, is_hunk boolean")] * 9
    assembly._tables(*views, often=assembly._OFTEN[:2])
    assert asked == ["fx_commit_full", "fx_process"]


def test_edges_between_commits_need_no_graph_of_a_commit(spark, monkeypatch):
    from histoloom.operators import history_graph

    monkeypatch.setattr(history_graph, "counted_graph", lambda *_: 1 / 0)
    files = spark.createDataFrame([("a", "f", "MODIFY", 1, 1, 1, 1), ("b", "f", "MODIFY", 1, 3, 1, 1)], "hash string, filename string, change_type string, num_lines_added int, complexity int, num_lines_of_code int, token_count int")
    commits = spark.createDataFrame([("a", "r", 0), ("b", "r", 1)], "hash string, repo_url string, day int").selectExpr("hash", "repo_url", "timestamp_seconds(day * 86400) AS author_date")
    got = history_graph.between_commits({"file_info": files, "commit_info": commits}, ("files",))
    assert {(r.rel, r.src_hash, r.dst_hash) for r in got.collect()} == {("file_evolution", "a", "b"), ("precedes", "a", "b")}
