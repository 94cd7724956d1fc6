"""Readers, merges and sinks."""

import json
import random

from pyspark.sql import functions as F

from histoloom import api
from histoloom.operators import nodes as node_tables
from histoloom.operators import history
from histoloom.sources import store, tables
from histoloom.streaming import evolution


def test_tolerant_csv(spark, tmp_path):
    (tmp_path / "commit_info_v4.csv").write_text('hash,commit_type,extra,num_lines_added\nh1,VCC,z,3\nh2,FC,"a\nb",bad\n')
    (tmp_path / "commit_info_v3.csv").write_text("hash\nold\n")
    found = tables.load_tables(spark, f"file://{tmp_path}", ["commit_info", "file_info"])
    got = {r.hash: r for r in found["commit_info"].collect()}
    assert set(got) == {"h1", "h2"} and got["h1"].num_lines_added == 3.0 and got["h2"].num_lines_added is None and got["h1"].msg is None
    assert found["file_info"].count() == 0 and "code_before" not in found["file_info"].columns
    assert tables.first_existing(spark, [f"file://{tmp_path}/none.csv"]) is None


def test_splittable_csv_without_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f"{i},x{i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        one, many = (tables.read_csv(spark, f"file://{path}", "a int", line_breaks=x) for x in (True, False))
        assert one.count() == many.count() == 20_000 and many.agg(F.sum("a")).first()[0] == 199_990_000
        parts = [df.select(F.spark_partition_id().alias("p")).distinct().count() for df in (one, many)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts[0] == 1 < parts[1]


def test_key_filters_and_counts(spark):
    rows = spark.createDataFrame([("a", "x", 1, "big"), ("b", "a", 2, "big"), ("c", "d", 3, "big"), ("a", "a", 4, "big"), (None, "a", 5, "big")], "fc_hash string, vcc_hash string, v int, body string")
    wanted = spark.createDataFrame([("a",), ("a",)], "hash string")
    got = tables.of_hashes(rows, wanted, ["body"])
    assert got.columns == ["fc_hash", "vcc_hash", "v"] and sorted(r.v for r in got.collect()) == [1, 2, 4, 5]
    assert {(r.fc_hash, r.n) for r in tables.counts_of(rows, spark.createDataFrame([("a",), ("z",)], "fc_hash string"), "fc_hash").collect()} == {("a", 2)}


def test_merge_of_generations(spark):
    old = spark.createDataFrame([("a", 1.0)], "hash string, days_since_prev_tag double")
    new = spark.createDataFrame([("a", 9.0, 1), ("b", 2.0, 1)], "hash string, time_since_last_tag double, extra int")
    got = {r.hash: (r.days_since_prev_tag, r.extra) for r in tables.merged(old, new).collect()}
    assert got == {"a": (1.0, None), "b": (2.0, 1)}


def test_run_files_of_both_layouts(spark, tmp_path):
    for path, value in (("one/seed_3/results.json", 0.5), ("one/seed4/results.json", 0.6), ("two/results.json", 0.7)):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps({"auc": value, "history": [1, 2]}, indent=1))
    paths = [f"file://{tmp_path}/{p}" for p in ("*/seed*/results.json", "*/results.json")]
    got = [r for p in paths for r in tables.read_run_files(spark, p, "auc double").collect()]
    assert {(r.run, r.seed, r.auc) for r in got} == {("one", 3, 0.5), ("one", 4, 0.6), ("two", None, 0.7)}


def test_published_split(spark, tmp_path):
    rows = [(f"h{i}", i % 2, f"r{i % 3}", f"2020-01-{i + 1:02d}", ["train", "val", "test"][i % 3], 0.5) for i in range(12)]
    split = spark.createDataFrame(rows, "hash string, label int, repo_url string, author_date string, repo_split string, hn_score double").withColumn("author_date", F.to_date("author_date")).withColumn("other", F.lit(1))
    out = f"file://{tmp_path}/out"
    api.publish_split(split, out, "repo")
    api.publish_split(split.drop("hn_score"), out, "temporal")
    index = spark.read.option("mergeSchema", True).parquet(f"{out}/index")
    assert index.count() == 24 and "other" not in index.columns and {r.strategy for r in index.select("strategy").distinct().collect()} == {"repo", "temporal"}
    meta = {r.repo_split: r for r in spark.read.json(f"{out}/metadata/repo").collect()}
    assert meta["train"].n == 4 and meta["train"].n_repos == 1 and meta["test"].strategy == "repo"
    leaks = {r.finding: r.status for r in spark.read.json(f"{out}/leakage/repo").collect()}
    assert leaks["repo_overlap"] == "PASS" and leaks["future_leak"] == "BY-DESIGN"


def test_graph_store_and_tables(spark, tmp_path):
    nodes = spark.createDataFrame([("h", "file", "f", [1.0]), ("h", "commit", "h", [2.0])], "hash string, type string, node_key string, x array<double>")
    edges = spark.createDataFrame([("h", "has", "h", "f")], "hash string, rel string, src_key string, dst_key string")
    tables.write_graphs(nodes, edges, f"file://{tmp_path}/g")
    assert sorted(p.name for p in (tmp_path / "g/nodes").iterdir() if p.is_dir()) == ["type=commit", "type=file"]
    back = spark.read.parquet(f"file://{tmp_path}/g/nodes").where("type = 'file'").collect()
    assert [(r.node_key, r.x) for r in back] == [("f", [1.0])] and spark.read.parquet(f"file://{tmp_path}/g/edges").where("rel = 'has'").count() == 1
    tables.write_table(spark.createDataFrame([("a", 1)], "run string, n int"), f"file://{tmp_path}/t")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/t").first().asDict() == {"run": "a", "n": "1"}
    tables.write_report(spark.createDataFrame([("a", 1)], "run string, n int"), f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r").first().n == 1


def exchanges_below(plan: str, scan: str) -> int:
    """Exchanges on the path from the plan's root to the scan whose line holds a text."""
    path = []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, line))
        if "Scan parquet" in line and scan in line:
            return sum("Exchange" in x for _, x in path)
    raise AssertionError(plan)


def test_vectors_of_a_store_are_not_moved(spark, tmp_path):
    rows = [(f"h{i % 40}", f"n{i % 7}", "f", [float(i)] * 768, i) for i in range(400)] + [("h1", "n1", "f", None, -1)]
    vectors = spark.createDataFrame(rows, "hash string, name string, filename string, emb array<float>, seq int")
    found = store.write_embeddings(vectors, "vectors_768", f"file://{tmp_path}/v", 6)
    last = {}
    for h, n, f, v, q in sorted(rows, key=lambda r: r[4]):
        last[h, n, f] = v
    assert {(r.hash, r.name, r.filename): list(r.emb) for r in found.collect()} == last
    functions = spark.createDataFrame([(h, n, f, 1) for h, n, f in list(last)[:50]] + [("none", "n", "f", 1)], "hash string, name string, filename string, start_line int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = node_tables.function_nodes(functions, found)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert exchanges_below(plan, "emb#") == 0 and "Bucketed: true" in plan
        got = {r.node_key: r.x for r in made.where("hash = 'h1' OR hash = 'none'").collect()}
        assert got["f::n"][8:] == [0.0] * 768 and all(len(x) == 776 for x in got.values())
        assert all(got[f"f::{n}"][8:] == last["h1", n, "f"] for h, n, f in list(last)[:50] if h == "h1")
        spark.sql("DROP TABLE vectors_768")
        again = store.open_bucketed(spark, "vectors_again", f"file://{tmp_path}/v", "hash string, name string, filename string, emb array<float>", 6, store.EMBEDDING_KEYS)
        assert again.count() == len(last) and exchanges_below(node_tables.function_nodes(functions, again)._jdf.queryExecution().executedPlan().toString(), "emb#") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_commit_is_read_from_one_bucket(spark, tmp_path):
    nodes = spark.createDataFrame([(f"h{i}", t, f"k{i}", [1.0]) for i in range(60) for t in ("file", "commit")], "hash string, type string, node_key string, x array<double>")
    edges = spark.createDataFrame([(f"h{i}", "has", f"h{i}", f"k{i}") for i in range(60)], "hash string, rel string, src_key string, dst_key string")
    store.write_graph_store(nodes, edges, "some_graphs", f"file://{tmp_path}/g", 5)
    n, e = store.graph_of(spark, "some_graphs", "h7")
    assert sorted((r.type, r.node_key) for r in n.collect()) == [("commit", "k7"), ("file", "k7")] and [(r.rel, r.dst_key) for r in e.collect()] == [("has", "k7")]
    own = {r.p.rsplit("/", 1)[-1] for t in (n, e) for r in t.select(F.input_file_name().alias("p")).collect()}
    assert len({name.split("_")[-1] for name in own}) == 1
    for file in (tmp_path / "g").rglob("part-*.parquet"):  # no other bucket is opened
        if file.name not in own:
            file.write_bytes(b"not a table")
    assert n.count() == 2 and e.count() == 1


SNAPSHOTS = "hash string, repo_url string, author_date timestamp, filename string, complexity double, num_lines_of_code double"


def snapshots(spark, n=120):
    r = random.Random(3)
    commits = [(f"c{i:03d}", r.choice("rs"), r.choice([None, r.randint(0, 40) * 86400])) for i in range(n)]
    rows = [(h, repo, d, f"f{f}", float(r.randint(0, 9)), float(r.randint(0, 9))) for h, repo, d in commits for f in r.sample(range(5), 2)]
    return spark.createDataFrame(rows, SNAPSHOTS.replace("timestamp", "long")).withColumn("author_date", F.timestamp_seconds("author_date")).select(*[c.split()[0] for c in SNAPSHOTS.split(", ")])


def edges_of(df):
    return sorted((r.filename, r.src, r.dst, round(r.d_complexity, 6), round(r.d_lines, 6), round(r.gap, 6)) for r in df.collect())


def test_batches_in_any_order_give_the_edges_of_one(spark, tmp_path):
    rows = snapshots(spark).persist()
    whole = edges_of(history.file_evolution(rows.drop("repo_url", "author_date"), rows.select("hash", "repo_url", "author_date").distinct()))
    path = f"file://{tmp_path}/state"
    assert evolution.current_edges(spark, path) is None
    part = lambda i: rows.where(F.pmod(F.xxhash64("hash"), F.lit(4)) == i)
    for batch in range(4):
        evolution.add_batch(part(batch), batch, path, buckets=4)
        if batch == 2:  # repeated, as after a failure, and with rows known already
            evolution.add_batch(part(batch).unionByName(part(0)), batch, path, buckets=4)
    assert edges_of(evolution.current_edges(spark, path)) == whole
    changed = rows.where("hash < 'c010'").withColumn("complexity", F.lit(50.0))  # the last word on a snapshot counts
    evolution.add_batch(changed, 4, path, buckets=4)
    after = rows.where("hash >= 'c010'").unionByName(changed)
    assert edges_of(evolution.current_edges(spark, path)) == edges_of(history.file_evolution(after.drop("repo_url", "author_date"), after.select("hash", "repo_url", "author_date").distinct()))


def test_evolution_of_a_stream(spark, tmp_path):
    rows = snapshots(spark, 30).persist()
    for i in (2, 0, 1):
        rows.where(F.pmod(F.xxhash64("hash"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    place = [f"file://{tmp_path}/{x}" for x in ("in", "state", "checkpoint")]
    for _ in range(2):  # the second run finds nothing new
        evolution.evolve_as_they_come(spark, place[0], SNAPSHOTS, place[1], place[2], buckets=2).awaitTermination(120)
    assert edges_of(evolution.current_edges(spark, place[1])) == edges_of(history.file_evolution(rows.drop("repo_url", "author_date"), rows.select("hash", "repo_url", "author_date").distinct()))
