"""Hand-made cases of rules that are easy to get wrong."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from histoloom import api
from histoloom.functions import scalars as c
from histoloom.functions import quantiles, vectors
from histoloom.functions.shared import with_global_rank, with_last_seen, with_running_sums
from histoloom.operators import attribution, audits, cleaning, edges, graphs, history, history_graph, metrics, nodes, ownership, runs, scaling, splits, statistics
from histoloom.sources import tables


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]


def test_days_are_rounded_down_not_midnights(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 23:50:00' AS a, timestamp'2024-01-02 00:10:00' AS b")
    assert one(df.select(c.floor_days(F.col("b"), F.col("a")).alias("d"))).d == 0
    assert one(df.select(c.floor_days(F.col("a"), F.col("b")).alias("d"))).d == -1


def test_average_precision_and_auc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "score double, label int")
    assert one(metrics.average_precision(df)).ap == pytest.approx(0.8333333333)
    assert one(metrics.roc_auc(df)).auc == pytest.approx(0.75)


def test_no_positives(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 0)], "score double, label int")
    found = one(metrics.best_threshold_sweep(df))
    assert (found.best_f1, found.threshold) == (0.0, 0.5)
    assert one(metrics.average_precision(df)).ap == 0 and one(metrics.roc_auc(df)).auc == 0
    assert one(metrics.rates(metrics.confusion(df))).mcc == 0


def test_sweep_thresholds_are_sums(spark):
    df = spark.createDataFrame([(0.15, 1), (0.1, 0)], "score double, label int")
    # 0.15 lies below 0.05 + 2 * 0.05 = 0.15000000000000002.
    assert one(metrics.best_threshold_sweep(df)).best_f1 == pytest.approx(2 / 3)


def test_tags(spark):
    df = spark.createDataFrame([("v1.2.0-rc1", 3), ("v2.0", -3), ("hotfix", 0), ("0.0", 1)], "tag string, days int")
    found = {r.tag: r for r in df.select("tag", *[v.alias(k) for k, v in c.parsed_tag(F.col("tag"), F.col("days")).items()]).collect()}
    a, b, d, z = (found[t] for t in ("v1.2.0-rc1", "v2.0", "hotfix", "0.0"))
    assert (a.major, a.minor, a.patch, a.prerelease, a.major_bump) == (1, 2, 0, 1, 0) and a.log_days == pytest.approx(math.log1p(3))
    assert (b.major_bump, b.log_days) == (1, pytest.approx(-math.log1p(3)))
    assert (d.major, d.minor, d.patch, d.hotfix) == (0, 0, 0, 1)
    assert z.major_bump == 0


def test_inferred_change(spark):
    df = spark.createDataFrame([("h", "a", True), ("h", "b", False), ("h", "c", True), ("h", "c", False)], "hash string, name string, before_change boolean")
    found = {r.name: r.function_change_type for r in cleaning.inferred_change(df).collect()}
    assert found == {"a": "DELETE", "b": "ADD", "c": "MODIFY"}


def test_one_hot_defaults(spark):
    df = spark.createDataFrame([("COPY",), ("odd",), (None,)], "t string")
    assert [r.x for r in df.select(c.one_hot(F.col("t"), c.FILE_CHANGES, "UNKNOWN").alias("x")).collect()] == [[0, 0, 0, 0, 1, 0], [0, 0, 0, 0, 0, 1], [0, 0, 0, 0, 0, 1]]


def test_capped_ratio(spark):
    df = spark.createDataFrame([(7.0, 1.0), (3.0, 0.0)], "a double, b double")
    assert [r.x for r in df.select(c.capped_ratio(F.col("a"), F.col("b"), 5.0).alias("x")).collect()] == [5.0, 3.0]


def test_tolerant_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "v string")
    assert [r.x for r in df.select(c.safe_double(df, "v").alias("x")).collect()] == [1.5, 0.0, 0.0, 0.0]
    assert one(df.limit(1).select(c.safe_double(df, "absent").alias("x"))).x == 0.0


def test_scaler_needs_rows_and_constant_is_safe(spark):
    rows = [(f"h{i}", "big", [5.0, float(i)]) for i in range(12)] + [(f"s{i}", "small", [1.0, 1.0]) for i in range(9)] + [("bad", "big", [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "hash string, repo_url string, x array<double>").withColumn("group", F.lit("g"))
    split = df.select("hash", F.lit("train").alias("repo_split"))
    fit = {(r.repo_url, r.dim): r for r in scaling.fit_scaler(df, split).collect()}
    assert set(fit) == {("big", 0), ("big", 1)} and fit["big", 0].std == 1e-6 and fit["big", 0].n == 12
    small = scaling.apply_scaler(df, scaling.fit_scaler(df, split)).where("repo_url = 'small'").select("x").distinct()
    assert one(small).x == [1.0, 1.0]


def test_scaler_sees_train_only(spark):
    df = spark.createDataFrame([(f"h{i}", "r", [float(i)]) for i in range(20)], "hash string, repo_url string, x array<double>").withColumn("group", F.lit("g"))
    split = df.select("hash", F.when(F.col("x")[0] < 10, "train").otherwise("test").alias("repo_split"))
    assert one(scaling.fit_scaler(df, split)).mean == 4.5


def test_temporal_sizes(spark):
    df = spark.sql("SELECT cast(id as string) hash, 1 label, 'r' repo_url, date_add(date'2020-01-01', cast(id as int)) author_date FROM range(20) UNION ALL SELECT 'u', 0, 'r', null")
    found = {r.repo_split: r.n for r in splits.by_time(df).groupBy("repo_split").agg(F.count("*").alias("n")).collect()}
    assert found == {"train": 15, "val": 3, "test": 3}


def test_ownership(spark):
    df = spark.createDataFrame([("h", "f", "a", 0.7, 10.0), ("h", "f", "b", 0.3, 10.0)], "commit_hash string, filename string, dev_email string, ownership_ratio double, total_lines double")
    found = one(ownership.file_ownership(df))
    assert found.hhi == pytest.approx(0.58) and found.max_ratio == 0.7 and found.owners == pytest.approx(math.log1p(2))


def test_window_tie_takes_the_smaller(spark):
    df = spark.createDataFrame([("h", 60), ("h", 120)], "commit_hash string, window_days int")
    assert one(ownership.choose_window(df)).window_days == 60


def test_basename_fallback(spark):
    files = spark.createDataFrame([("h", "src/a.c"), ("h", "b.c")], "hash string, filename string")
    owned = spark.createDataFrame([("h", "src/a.c"), ("h", "lib/b.c"), ("h", "none.c")], "commit_hash string, file_path string")
    assert {(r.file_path, r.filename) for r in ownership.match_files(files, owned).collect()} == {("src/a.c", "src/a.c"), ("lib/b.c", "b.c")}


def test_evolution_skips_rows_of_one_commit(spark):
    commits = spark.sql("SELECT * FROM VALUES ('A', 'r', timestamp'2020-01-01 00:00:00'), ('B', 'r', timestamp'2020-01-05 00:00:00') AS t(hash, repo_url, author_date)")
    files = spark.createDataFrame([("A", "f", 1.0, 1.0), ("A", "f", 2.0, 1.0), ("B", "f", 4.0, 1.0), ("A", "", 1.0, 1.0), ("B", "", 1.0, 1.0)], "hash string, filename string, complexity double, num_lines_added double")
    found = history.file_evolution(files, commits).collect()
    assert [(r.src, r.dst) for r in found] == [("A", "B")] and found[0].gap == pytest.approx(math.log1p(4))


def test_two_player_game(spark):
    df = spark.createDataFrame([("h", 0, 0.0), ("h", 1, 0.2), ("h", 2, 0.4), ("h", 3, 1.0)], "hash string, mask long, prob double")
    assert {r.player: round(r.phi, 9) for r in attribution.shapley(df, 2).collect()} == {0: 0.4, 1: 0.6}
    assert {r.player: round(r.phi, 4) for r in attribution.kernel_shap(df, [0, 1, 2, 3], 2).collect()} == {0: 0.4, 1: 0.6}
    assert one(attribution.efficiency_errors(attribution.shapley(df, 2), df, 2)).max_error < 1e-12


def test_quantiles_of_hot_ragged_and_missing_values(spark):
    r = random.Random(6)
    rows = [(k, r.choice([0.0, 0.0, r.gauss(0, 5), None]), float(r.randint(0, 3)) if k != "c" else None) for k in ("a", "b", "c", None) for _ in range(r.randint(1, 200))] + [("one", 2.5, -1.0)]
    df = spark.createDataFrame(rows, "k string, u double, v double").repartition(6)
    wanted = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {(x["k"], x["column"]): [x[f"q{p:g}"] for p in wanted] for x in quantiles.quantiles(df, ["u", "v"], wanted, ["k"]).collect()}
    for at, c in ((1, "u"), (2, "v")):
        for k in {x[0] for x in rows}:
            values = [x[at] for x in rows if x[0] == k and x[at] is not None]
            assert (k, c) in got if values else (k, c) not in got
            if values:
                assert got[k, c] == pytest.approx(np.quantile(values, wanted).tolist())
    whole = quantiles.quantiles(df, {"w": F.col("u") * 2}, [0.5])
    assert one(whole)["q0.5"] == pytest.approx(2 * np.median([x[1] for x in rows if x[1] is not None]))
    assert "percentile" not in whole._jdf.queryExecution().toString() and quantiles.quantiles(df.where("false"), ["u"], [0.5]).collect() == []
    assert {x.k: x.v for x in cleaning.impute_median(df.where("k = 'a'").withColumn("v", F.lit(None).cast("double")), ["v"]).select("k", "v").collect()} == {"a": None}


def test_sampled_coalitions(spark):
    for m, most in ((20, 300), (9, 100), (62, 500), (3, 1), (1, 5)):
        found = attribution.sampled_coalitions(m, most)
        masks = [x for x, _ in found]
        assert found == attribution.sampled_coalitions(m, most) and len(set(masks)) == len(masks) and len(masks) <= most + 2
        assert {0, (1 << m) - 1} <= set(masks) and all((1 << m) - 1 - x in masks for x in masks) and all(w > 0 for _, w in found)
    assert len(attribution.sampled_coalitions(20, 300)) > 290 and len(attribution.sampled_coalitions(6, 1000)) == 64
    assert attribution.sampled_coalitions(20, 300, 1) != attribution.sampled_coalitions(20, 300, 2)


def test_sampled_kernel_comes_near_exact_values(spark):
    r, m = random.Random(2), 12
    main, pairs, threes = [r.uniform(-1, 1) for _ in range(m)], [(r.sample(range(m), 2), r.uniform(-1, 1)) for _ in range(20)], [(r.sample(range(m), 3), r.uniform(-0.3, 0.3)) for _ in range(10)]
    score = lambda mask: 0.5 + sum(x for i, x in enumerate(main) if mask >> i & 1) + sum(x for g, x in pairs + threes if all(mask >> i & 1 for i in g))
    exact = [x + sum(y / len(g) for g, y in pairs + threes if i in g) for i, x in enumerate(main)]
    for most, off in ((300, 0.05), (1 << m, 1e-5)):
        drawn = attribution.sampled_coalitions(m, most)
        scores = spark.createDataFrame([("h", mask, score(mask)) for mask, _ in drawn], "hash string, mask long, prob double")
        phi = {x.player: x.phi for x in attribution.kernel_shap(scores, drawn, m).collect()}
        assert max(abs(phi[i] - exact[i]) for i in range(m)) < off
        assert sum(phi.values()) == pytest.approx(score((1 << m) - 1) - score(0))


def test_sampled_scores_of_a_model(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    r = random.Random(9)
    rows = [(str(i), r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1)) for i in range(60)]
    df = spark.createDataFrame([(*x, float(x[1] + 0.5 * x[2] + r.gauss(0, 0.3) > 0)) for x in rows], "hash string, a double, b double, c double, label double")
    model = LogisticRegression(regParam=0.1).fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df))
    some = [(0, 1e6), (3, 1.0), (4, 1.0), (7, 1e6)]
    got = {(x.hash, x.mask): x.prob for x in attribution.coalition_scores(df, {"A": ["a"], "B": ["b"], "C": ["c"]}, model, ["a", "b", "c"], coalitions=some).collect()}
    assert len(got) == 4 * len(rows)
    w, bias = model.coefficients.toArray(), model.intercept
    for h, *x in rows:
        for mask, _ in some:
            z = bias + sum(w[i] * x[i] for i in range(3) if mask >> i & 1)
            assert got[h, mask] == pytest.approx(1 / (1 + math.exp(-z)))


def test_folds_are_greedy(spark):
    sizes = {"a": 5, "b": 4, "c": 3, "d": 3, "e": 1}
    df = spark.createDataFrame([(f"{r}{i}", r) for r, n in sizes.items() for i in range(n)], "hash string, repo_url string")
    found = {r.repo_url: r.fold for r in splits.repo_folds(df, 2).select("repo_url", "fold").distinct().collect()}
    load, expected = [0, 0], {}
    for r, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        expected[r] = load.index(min(load))
        load[expected[r]] += n
    assert found == expected


def test_runs_of_equal_sizes_are_dealt_as_one_by_one():
    r = random.Random(1)
    for _ in range(400):
        k = r.randint(1, 6)
        ours, theirs = [0] * k, [0] * k
        for n in sorted({r.randint(1, 12) for _ in range(r.randint(1, 5))}, reverse=True):
            count, expected = r.randint(1, 40), []
            for _ in range(count):
                expected.append(theirs.index(min(theirs)))
                theirs[expected[-1]] += n
            pieces = splits._turns(ours, n, count)
            ends = [first for first, _ in pieces[1:]] + [count]
            assert len(pieces) <= k and [folds[(t - first) % len(folds)] for (first, folds), end in zip(pieces, ends, strict=True) for t in range(first, end)] == expected
            assert ours == theirs


def test_folds_of_many_repositories(spark):
    r = random.Random(3)
    sizes = {f"r{i:03d}": r.choice([1, 1, 1, 2, 3, 17]) for i in range(300)}
    df = spark.createDataFrame([(f"{name}-{i}", name) for name, n in sizes.items() for i in range(n)], "hash string, repo_url string").repartition(7)
    load, expected = [0] * 4, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        expected[name] = load.index(min(load))
        load[expected[name]] += n
    found = splits.repo_folds(df, 4).select("repo_url", "fold").collect()
    assert len(found) == sum(sizes.values()) and {x.repo_url: x.fold for x in found} == expected


def test_last_seen_across_parts(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([None, None, None, r.randint(0, 99)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(5)
    for order, back in ((F.col("t"), False), (F.desc("t"), True)):
        expected, seen = {}, {}
        for k, t, v in sorted(rows, key=lambda x: x[1], reverse=back):
            seen[k] = seen.get(k) if v is None else v
            expected[t] = seen[k]
        got = with_last_seen(df, ["k"], [order], F.col("v"), "last")
        assert got.columns == ["k", "t", "v", "last"] and {x.t: x["last"] for x in got.collect()} == expected


def test_tags_kept_by_repository(spark):
    r = random.Random(8)
    tags = [(r.choice("rs"), f"t{i:02d}", r.randint(0, 60) * 43200) for i in range(40)]
    commits = [(f"c{i:02d}", r.choice("rrsu"), r.choice([None, r.randint(0, 60) * 43200])) for i in range(60)]
    expected = set()
    for h, repo, at in commits:
        if at is None:
            continue
        away = [(at - t, i) for key, i, t in tags if key == repo]
        for side, found in ((1, [(x, i) for x, i in away if x >= 86400]), (0, [(-x, i) for x, i in away if x < 86400])):
            if found:
                x, i = min(found)
                expected.add((h, i, (x if side else -x) // 86400, side))
    time = lambda df, c: df.withColumn(c, F.timestamp_seconds(c))
    got = nodes.bracketing_tags(time(spark.createDataFrame(commits, "hash string, repo_url string, author_date int"), "author_date"), time(spark.createDataFrame(tags, "repo_url string, tag_id string, created_at int"), "created_at"), "repo_url")
    assert {(x.hash, x.tag_id, x.days, x.is_before) for x in got.collect()} == expected
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()


def test_resample_follows_weights(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("z", 0.0)], "hash string, w double")
    found = {r.hash: r.n for r in splits.weighted_resample(df, "w", 4000).groupBy("hash").agg(F.count("*").alias("n")).collect()}
    assert sum(found.values()) == 4000 and set(found) == {"a", "b"} and 2800 < found["a"] < 3200


def test_global_rank_over_partitions(spark):
    values = [(random.Random(i).randint(0, 50), i) for i in range(500)]
    df = with_global_rank(spark.createDataFrame(values, "v int, i int").repartition(7), [F.col("v"), F.col("i")])
    assert [(r.v, r.i) for r in sorted(df.collect(), key=lambda r: r["rank"])] == sorted(values) and one(df.select("total").distinct()).total == 500


def test_masks_are_idempotent_and_edges_drop_in_pairs(spark):
    n = spark.createDataFrame([("h", "file", "f", [1.0, 2.0, 3.0])], "hash string, type string, node_key string, x array<double>")
    mask = scaling.named_mask(spark, "file:1")
    once = scaling.apply_mask(n, mask)
    assert one(once).x == [1.0, 0.0, 3.0] == one(scaling.apply_mask(once, mask)).x
    e = [("h", "r", "commit", "h", "file", str(i)) for i in range(200)] + [("h", "q", "file", str(i), "commit", "h") for i in range(200)]
    kept = graphs.drop_edges(spark.createDataFrame(e, "hash string, rel string, src_type string, src_key string, dst_type string, dst_key string"), 0.5, 3).collect()
    assert {r.dst_key for r in kept if r.rel == "r"} == {r.src_key for r in kept if r.rel == "q"} and 50 < len(kept) < 350


def test_commit_cannot_be_dropped(spark):
    with pytest.raises(ValueError):
        graphs.without_types(None, None, ["commit"])


def test_developers_in_role_order(spark):
    roles = spark.createDataFrame([("h", "committer", " B@x "), ("h", "author", "c@x")], "commit_hash string, role string, dev_id string")
    owned = spark.createDataFrame([("h", "a@x", 0.5), ("h", "b@x", 0.9), ("h", "d@x", 0.01)], "commit_hash string, dev_email string, ownership_ratio double")
    assert [r.email for r in nodes.developers(roles, owned).orderBy("place").collect()] == ["c@x", "b@x", "a@x"]


def test_bracketing_tags(spark):
    commits = spark.sql("SELECT 'h' AS hash, timestamp'2020-01-10 00:00:00' AS author_date")
    tags = spark.sql("SELECT 'h' AS hash, * FROM VALUES ('old', timestamp'2020-01-01 00:00:00'), ('prev', timestamp'2020-01-08 00:00:00'), ('next', timestamp'2020-01-10 12:00:00'), ('late', timestamp'2020-02-01 00:00:00') AS t(tag_id, created_at)")
    assert {(r.tag_id, r.is_before) for r in nodes.bracketing_tags(commits, tags).collect()} == {("prev", 1), ("next", 0)}


def test_co_modified_goes_both_ways(spark):
    f = spark.createDataFrame([("h", "f", "a", 1, 4.0), ("h", "f", "b", 3, 2.0)], "hash string, filename string, name string, start_line int, complexity double")
    found = {(r.a, r.b): (r.nearness, r.likeness) for r in edges.co_modified(f).collect()}
    assert found["a", "b"] == found["b", "a"] == (pytest.approx(1 / 3), pytest.approx(1 - 2 / 6))


def test_last_fix_wins(spark):
    df = spark.createDataFrame([("f1", "['aaa1234', 'BBB1234', None, nan]", 1), ("f2", "['aaa1234', 'abc']", 2), ("", "['ccc1234']", 3)], "fc_hash string, vcc_hash string, seq int")
    assert {(r.vcc_hash, r.fc_hash) for r in cleaning.fix_of(df, "seq").collect()} == {("aaa1234", "f2"), ("BBB1234", "f1")}


def test_parents_are_hashes_only(spark):
    df = spark.createDataFrame([("a", "['0123456789abcdef0123456789abcdef01234567', 'feedbeef']"), ("b", "nan"), ("c", "[None]"), ("d", None)], "hash string, parents string")
    found = {r.hash: (r.parent_list, r.is_merge) for r in cleaning.with_parents(df).collect()}
    assert found["a"] == (["0123456789abcdef0123456789abcdef01234567", "feedbeef"], True) and found["b"] == found["c"] == ([], False)


def test_references_by_number(spark):
    pulls = spark.createDataFrame([("h", "p1", "i1", "see #7"), ("h", "p2", None, "fixes #7 and #9")], "hash string, pr_id string, linked string, body string")
    issues = spark.createDataFrame([("h", "i1", 5), ("h", "i2", 7)], "hash string, issue_id string, issue_number int")
    assert {(r.pr_id, r.issue_id) for r in cleaning.references(pulls, issues, ["linked"], ["body"]).collect()} == {("p1", "i1"), ("p2", "i2")}


def test_mann_whitney_ties(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (2.0, 1), (3.0, 1), (4.0, 1)], "v double, label int")
    found = one(statistics.mann_whitney(df, "v", "label"))
    assert found.u == 5.5 and 0 < found.p < 1


def test_early_stop_and_seed_names(spark):
    df = spark.createDataFrame([("r_s1", e, "val", v) for e, v in enumerate([0.1, 0.3, 0.2, 0.3, 0.25, 0.5])], "run string, epoch int, split string, ap double")
    assert one(runs.early_stop(df, "ap", ["run"], 3)).stop_epoch == 4
    assert one(df.select(runs.run_name().alias("n")).distinct()).n == "r"


def test_misaligned_and_orphans(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "i int, k string")
    b = spark.createDataFrame([(0, "x"), (1, "z"), (2, "w")], "i int, k string")
    assert {r._pos for r in audits.misaligned(a, b, "i", ["k"]).collect()} == {1, 2}
    assert [r.key for r in audits.orphan_keys(a, b, "k", "k").collect()] == ["y"]


def test_generations_and_rejects(spark):
    old = spark.createDataFrame([("a", 1)], "hash string, v int")
    new = spark.createDataFrame([("a", 2, 9), ("b", 3, 9)], "hash string, v int, w int")
    assert {(r.hash, r.v) for r in tables.gap_filled(old, new).collect()} == {("a", 1), ("b", 3)}
    commits = spark.createDataFrame([("a", "VCC"), ("b", "FC"), ("c", "FC"), ("d", None)], "hash string, commit_type string")
    has = lambda *h: spark.createDataFrame([(x,) for x in h], "hash string")
    built, rejected = tables.split_rejects(commits, has("a", "c"), has("a"), has("a"))
    assert [r.hash for r in built.collect()] == ["a"]
    assert {(r.hash, r.reason) for r in rejected.collect()} == {("b", "missing_commit_features"), ("c", "no_code_rows"), ("d", "missing_commit_info")}
    assert [r.hash for r in tables.to_build(commits, has("a"), limit=2).collect()] == ["b", "c"]


def test_stream_builds_each_commit_once(spark, tmp_path):
    from histoloom.streaming.incremental import build_as_they_come

    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    spark.createDataFrame([("a",), ("b",)], "hash string").write.parquet(src)
    build_as_they_come(spark, src, "hash string", lambda df: df, out, check).awaitTermination()
    spark.createDataFrame([("b",), ("c",)], "hash string").write.mode("append").parquet(src)
    build_as_they_come(spark, src, "hash string", lambda df: df, out, check).awaitTermination()
    assert sorted(r.hash for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


@pytest.fixture(scope="module")
def source_tables(spark):
    from compare import SMALL

    from histoloom.plans.assembly import _SOURCES, _tables
    from histoloom.plans.views import table

    return _tables(*[table(spark, SMALL, n) for n in _SOURCES])


@pytest.mark.parametrize("mode", [1, 4])
def test_graph_tables_have_no_dangling_ends(spark, source_tables, mode):
    n, e = api.build_graph_tables(source_tables, mode)
    assert audits.graph_problems(n, e, {"commit": 9 if mode == 4 else 7, "file": 10, "function": 10, "developer": 3, "issue": 2 if mode == 1 else 8, "pull_request": 1 if mode == 1 else 8, "release_tag": 1 if mode == 1 else 7}).where("n > 0").collect() == []


def test_second_generation_graphs(spark, source_tables):
    n, e = api.build_graph_tables_v2(source_tables)
    widths = {"commit": 14, "file": 3, "function": 8, "hunk": 2, "developer": 9, "issue": 4, "pull_request": 4, "release_tag": 4}
    assert audits.graph_problems(n, e, widths).where("n > 0").collect() == []
    sizes = {r.rel: r.n for r in e.groupBy("rel").agg(F.count("*").alias("n")).collect()}
    assert sizes["modifies_file"] == sizes["in_commit_file"] and sizes["owns"] == sizes["owned_by"] > 0 and sizes["linked_to_commit"] == 2 * sizes["has_issue"]
    widest = {r.rel: r.w for r in e.groupBy("rel").agg(F.max(F.size("attr")).alias("w")).collect()}
    assert [widest[r] for r in ("modifies_file", "modifies_func", "has_hunk", "authored_by", "owns", "has_issue", "has_release")] == [4, 11, 0, 3, 3, 3, 1]


def test_splits_by_name(spark, source_tables):
    commits = source_tables["commit_info"]
    found = {r.finding: r.status for r in api.validate_split(api.split(commits, "temporal"), "temporal").collect()}
    assert found["in_several_splits"] == "PASS" and found["repo_overlap"] == "BY-DESIGN"
    for name in ("developer", "file", "function"):
        parts = api.split(commits.select("hash", "label", "repo_url"), name, source_tables).groupBy("repo_split").count().collect()
        assert {r.repo_split for r in parts} == {"train", "val", "test"} and sum(r["count"] for r in parts) == commits.count()


def test_history_graph_is_one_graph(spark, source_tables):
    commits = source_tables["commit_info"]
    fixes = commits.where("commit_type = 'VCC'").select(F.col("hash").alias("vcc_hash"), "author").join(commits.where("commit_type = 'FC'").select(F.col("hash").alias("fc_hash"), "author"), "author").groupBy("vcc_hash").agg(F.min("fc_hash").alias("fc_hash"))
    few = commits.where("cast(hash as int) % 3 = 0").select("hash")
    n, e = api.build_history_graph({**source_tables, "fixes": fixes}, few, mode=4)
    n, e = n.persist(), e.persist()
    assert {r.hash for r in n.where("type = 'commit'").select("hash").collect()} == {r.hash for r in few.collect()}
    assert n.where("type = 'developer'").select("node_key").distinct().count() == n.where("type = 'developer'").count() > 0
    for side in ("src", "dst"):  # every end is a node
        assert e.join(n.select(F.col("type").alias(f"{side}_type"), F.col("hash").alias(f"{side}_hash"), F.col("node_key").alias(f"{side}_key")), [f"{side}_type", f"{side}_hash", f"{side}_key"], "left_anti").count() == 0
    widths = {(r.rel, r.src_type): (r.a, r.b) for r in e.groupBy("rel", "src_type").agg(F.min(F.size("attr")).alias("a"), F.max(F.size("attr")).alias("b")).collect()}
    assert all(a == b for a, b in widths.values())
    assert [widths[k][0] for k in (("file_evolution", "file"), ("fn_evolution", "function"), ("precedes", "commit"), ("owns", "developer"), ("has", "commit"))] == [4, 8, 1, 3, 10]
    assert n.groupBy("type").agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b")).where("a <> b").count() == 0
    ids, ended = api.number_graph(n, e)
    for r in ids.groupBy("type").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count_distinct("id").alias("n"), F.count("*").alias("all")).collect():
        assert (r.a, r.b, r.n) == (0, r.n - 1, r["all"])
    assert ended.count() == e.count()


def test_history_edges_by_hand(spark):
    commits = spark.sql("SELECT * FROM VALUES ('v', 'r', 'VCC', timestamp'2020-01-01 00:00:00', array()), ('f', 'r', 'FC', timestamp'2020-01-04 12:00:00', array('v', 'u')), ('u', 'r', 'normal', null, array('v', 'x')) AS t(hash, repo_url, commit_type, author_date, parent_list)")
    fixes = spark.createDataFrame([("v", "f"), ("v2", "f")], "vcc_hash string, fc_hash string")
    files = spark.createDataFrame([("v", "old.c", None, 5.0, 10.0), ("v", "same.c", None, 1.0, 1.0), ("f", "", "new.c", 2.0, 13.0), ("f", "same.c", None, 1.0, 1.0), ("f", None, None, 9.0, 9.0)], "hash string, filename string, new_path string, complexity double, num_lines_of_code double")
    got = {(r.src_key, r.dst_key): [round(x, 6) for x in r.attr] for r in history_graph.file_edges(files, commits, fixes).collect()}
    log = lambda x: round(math.log1p(x), 6)
    assert got == {("same.c", "same.c"): [0.0, 0.0, 0.0, log(3)], ("old.c", "new.c"): [-log(3), log(3), 0.0, log(3)], ("old.c", "same.c"): [-log(4), -log(9), 0.0, log(3)]}
    rows = [("v", "a.c", "one", 1, " rename", True, 4.0, 2.0), ("v", "a.c", "two", 2, "RENAME", False, 1.0, 2.0), ("v", "a.c", "lost", 0, "RENAME", True, 1.0, 1.0), ("f", "a.c", "three", 1, "MODIFY", False, 7.0, 7.0), ("f", "b.c", "two", 1, "add", False, 3.0, 2.0)]
    functions = spark.createDataFrame(rows, "hash string, filename string, name string, start_line int, function_change_type string, before_change boolean, complexity double, num_lines_of_code double")
    got = {(r.src_key, r.dst_key): ([int(x) for x in r.attr[:5]].index(1), [round(x, 6) for x in r.attr[5:]]) for r in history_graph.function_edges(functions, commits, fixes).collect()}
    assert got == {("a.c::two", "b.c::two"): (3, [log(2), 0.0, log(3)]), ("a.c::one", "a.c::two"): (3, [-log(3), 0.0, 0.0]), ("a.c::lost", "a.c::three"): (3, [0.0, 0.0, log(3)])}
    edges_ = {(r.rel, r.src_key, r.dst_key): [round(x, 6) for x in r.attr] for t in history_graph.commit_edges(commits) for r in t.collect()}
    assert edges_ == {("parent_of", "v", "f"): [log(3), 1.0], ("parent_of", "u", "f"): [0.0, 1.0], ("parent_of", "v", "u"): [0.0, 1.0], ("precedes", "u", "v"): [0.0], ("precedes", "v", "f"): [log(3)]}


def test_developers_are_shared_and_filled(spark):
    emails = spark.createDataFrame([("a@x",), ("b@x",), ("a@x",), ("c@x",)], "node_key string")
    info = spark.createDataFrame([(" A@x", 5, 3.0), ("a@x", 9, 1.0), ("b@x", 1, 7.0), ("c@x", 1, None)], "dev_id string, total_commits int, dev_commits_before double")
    got = {r.node_key: [round(v, 6) for v in r.x] for r in history.shared_developers(emails, info).collect()}
    mean = (math.log1p(1) + math.log1p(7)) / 2
    assert got == {"a@x": [0.0, round(math.log1p(1), 6), 0.0], "b@x": [0.0, round(math.log1p(7), 6), 0.0], "c@x": [0.0, round(mean, 6), 0.0]}
    assert {tuple(r.x) for r in history.shared_developers(emails, None).collect()} == {(0.0, 0.0, 0.0)}
    assert {tuple(r.x) for r in history.shared_developers(emails, info.where("dev_id = 'c@x'")).collect()} == {(0.0, 0.0, 0.0)}


@pytest.mark.parametrize("width", [3, 776])
def test_neighbour_vectors_keep_places(spark, width):
    rest = [0.5] * (width - 3)
    nodes_ = spark.createDataFrame([("h", "file", "a", [1.0, None, 3.0, *rest]), ("h", "file", "b", [3.0, None, None, *rest]), ("h", "dev", "d", [10.0]), ("h", "dev", "e", []), ("h", "commit", "h", [0.0])], "hash string, type string, node_key string, x array<double>")
    edges_ = spark.createDataFrame([("h", "of", "file", k, "commit", "h") for k in "ab"] + [("h", "by", "dev", k, "commit", "h") for k in "de"] + [("h", "only", "dev", "e", "file", "a")], "hash string, rel string, src_type string, src_key string, dst_type string, dst_key string")
    assert [(r.type, r.x) for r in graphs.neighbour_vectors(nodes_, edges_).collect()] == [("commit", [12.0, None, 3.0, *rest])]
    assert [(r.dim, r.value) for r in graphs.commit_readout(nodes_, edges_).orderBy("dim").collect()][:2] == [(0, 12.0), (2, 3.0)]


def test_moments_of_ragged_vectors(spark):
    r = random.Random(4)
    rows = [(k, [r.gauss(5, 2) for _ in range(r.choice((2, 3, 3)))]) for k in "ab" for _ in range(50)] + [("a", []), ("a", None)]
    got = {(x.k, x.dim): (x.n, x.mean, x.variance) for x in vectors.vector_moments(spark.createDataFrame(rows, "k string, x array<double>").repartition(5), ["k"]).collect()}
    for k in "ab":
        for d in range(3):
            v = [x[d] for key, x in rows if key == k and x and len(x) > d]
            assert got[k, d][0] == len(v) and got[k, d][1] == pytest.approx(sum(v) / len(v)) and got[k, d][2] == pytest.approx(sum((y - sum(v) / len(v)) ** 2 for y in v) / len(v))
    holed = spark.createDataFrame([("k", [1.0, None]), ("k", [2.0, 4.0, 6.0]), ("k", [None, None])], "k string, x array<double>")
    assert [(x.sums, x.counts) for x in vectors.vector_sums(holed, ["k"]).collect()] == [([3.0, 4.0, 6.0], [2.0, 1.0, 1.0])]


def test_undated_rows_have_no_gap(spark):
    commits = spark.sql("SELECT * FROM VALUES ('A', 'r', null), ('B', 'r', timestamp'2020-01-05 00:00:00'), ('C', 'r', timestamp'2020-01-07 00:00:00') AS t(hash, repo_url, author_date)")
    files = spark.createDataFrame([("A", "f", 1.0, 3.0), ("B", "f", None, 1.0), ("C", "f", 2.0, 1.0)], "hash string, filename string, complexity double, num_lines_of_code double")
    found = {r.src: r for r in history.file_evolution(files, commits).collect()}
    assert found["A"].gap == 0.0 and found["B"].gap == pytest.approx(math.log1p(2))
    assert found["A"].d_lines == pytest.approx(-math.log1p(2)) and found["A"].d_complexity == pytest.approx(-math.log1p(1)) and found["A"].d_tokens == 0.0


def test_owners_take_the_first_row(spark):
    owned = spark.createDataFrame([("h", "b/f", "f", "d", 0.2, 2.0, 10.0, 1.0), ("h", "a/f", "f", "d", 0.1, 1.0, 0.0, 0.0)], "commit_hash string, file_path string, filename string, dev_email string, ownership_ratio double, lines_owned double, total_lines double, edits_in_window double")
    devs = spark.createDataFrame([("h", "d")], "hash string, email string")
    found = one(edges.developer_file(owned, devs))
    assert (found.ratio, found.line_share, found.log_edits) == (0.1, 1.0, 0.0)


def test_parameters_by_form(spark):
    files = spark.createDataFrame([("h", "f", "ADD", 10.0, 0.0, 4.0)], "hash string, filename string, change_type string, num_lines_of_code double, complexity double, token_count double")
    rows = [("h", "f", "a", 1, 5.0, 9.0, 2.0, "['x', 'y']"), ("h", "f", "b", 4, 20.0, 1.0, 2.0, "[]"), ("h", "f", "c", 7, 1.0, 1.0, 2.0, None)]
    functions = spark.createDataFrame(rows, "hash string, filename string, name string, start_line int, num_lines_of_code double, complexity double, token_count double, parameters string")
    counted = {r.name: r.attr for r in edges.file_function_shares(files, functions).collect()}
    assert counted["a"] == pytest.approx([0.5, 5.0, 0.5, 0.0, math.log1p(10), 0.0, 0.0]) and counted["b"][0] == 1.0 and counted["c"][3:5] == [1.0, 0.0]
    lines = {r.name: r.attr for r in edges.file_function_shares(files, functions.withColumn("length", F.lit(5)), True).collect()}
    assert lines["a"] == pytest.approx([0.5, 9.0, 0.5, 0.1, 2.0, 0.0]) and lines["b"][4] == lines["c"][4] == 0.0


def test_masks_from_the_end_and_on_edges(spark):
    n = spark.createDataFrame([("h", "function", "f", [1.0] * 776), ("h", "function", "g", [1.0] * 10), ("h", "developer", "d", [1.0] * 9)], "hash string, type string, node_key string, x array<double>")
    e = spark.createDataFrame([("h", "owns", [1.0, 2.0]), ("h", "modifies_func", [1.0] * 11), ("h", "contains", [3.0])], "hash string, rel string, attr array<double>")
    x = {r.node_key: r.x for r in scaling.apply_named(n, e, "code_embedding", "developer")[0].collect()}
    assert x["f"] == [1.0] * 8 + [0.0] * 768 and x["g"] == [1.0] * 10 and x["d"] == [0.0] * 9
    a = {r.rel: r.attr for r in scaling.apply_named(n, e, "developer", "function_change_type")[1].collect()}
    assert a == {"owns": [0.0, 0.0], "modifies_func": [1.0] * 6 + [0.0] * 5, "contains": [3.0]}
    assert scaling.apply_mask(n, scaling.mask_table(spark, [])).count() == 3
    nodes_, _ = scaling.configured(n, e.withColumns({"src_type": F.lit("function"), "dst_type": F.lit("developer")}), "no_hunk")
    assert {r.node_key: sum(r.x) for r in nodes_.collect()} == {"f": 771.0, "g": 5.0, "d": 9.0}


def test_running_sums_over_hot_and_null_keys(spark):
    rows = [("hot", i) for i in range(300)] + [("cold", 5), (None, 1), (None, 2)]
    df = with_running_sums(spark.createDataFrame(rows, "k string, v int").repartition(5), ["k"], [F.col("v")], {"v": "s"}, totals=True)
    found = {(r.k, r.v): (r.s, r.s_all) for r in df.collect()}
    assert len(found) == 303 and all(found["hot", i] == (i * (i + 1) // 2, 44850) for i in range(300))
    assert found["cold", 5] == (5, 5) and found[None, 1] == (1, 3) and found[None, 2] == (3, 3)


def test_resample_of_one_heavy_row(spark):
    df = spark.createDataFrame([("heavy", 1e6)] + [(f"r{i}", 1.0) for i in range(200)], "hash string, w double")
    found = splits.weighted_resample(df, "w", 3000).groupBy("hash").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in found) == 3000 and max(r.n for r in found) > 2900


def test_neighbour_vectors_of_mixed_widths(spark):
    n = spark.createDataFrame([("h", "a", "1", [1.0, 2.0]), ("h", "a", "2", [3.0, 4.0]), ("h", "b", "1", [10.0])], "hash string, type string, node_key string, x array<double>")
    rows = [("h", "r", "a", "1", "c", "t"), ("h", "r", "a", "2", "c", "t"), ("h", "q", "b", "1", "c", "t")]
    e = spark.createDataFrame(rows, "hash string, rel string, src_type string, src_key string, dst_type string, dst_key string")
    assert one(graphs.neighbour_vectors(n, e)).x == [12.0, 3.0]
    assert graphs.neighbour_vectors(n.limit(0), e).count() == 0


def test_result_rows_drop_runs_without_val(spark):
    rows = [("a", 0, "val", 0.5), ("a", 1, "val", 0.7), ("a", 1, "train", 0.9), ("a", 0, "train", 0.8), ("a", 1, "test", 0.6), ("b", 0, "train", 0.9), ("c", 0, "val", 0.8)]
    found = runs.result_rows(spark.createDataFrame(rows, "run string, epoch int, split string, ap double"), "ap", ["run"]).collect()
    assert [(r.run, r.epoch, r.train_ap, r.val_ap, r.test_ap) for r in found] == [("c", 0, None, 0.8, None), ("a", 1, 0.9, 0.7, 0.6)]


def test_linear_gradients_by_block(spark):
    df = spark.createDataFrame([("h", 1.0, 2.0)], "hash string, a double, b double")
    found = {r.feature: r.value for r in attribution.linear_gradients(df, ["a", "b"], [0.5, -0.25], 0.1).collect()}
    p = 1 / (1 + math.exp(-0.1))
    assert found == {"a": pytest.approx(0.5 * p * (1 - p)), "b": pytest.approx(-0.5 * p * (1 - p))}
    assert one(attribution.block_totals(attribution.linear_gradients(df, ["a", "b"], [0.5, -0.25], 0.1), {"embedding": ["a", "b"]})).total == pytest.approx(0.0)


def test_missing_columns_and_alignment(spark):
    assert audits.missing_columns(spark.createDataFrame([("a", 1)], "hash string, v int"), ["hash", "x", "v"]) == ["x"]


def test_variance_inflation(spark):
    apart = spark.createDataFrame([(1.0, 0.0), (0.0, 2.0)], "a double, b double")
    assert [r.vif for r in statistics.variance_inflation(apart, ["a", "b"]).collect()] == pytest.approx([1.0, 1.0])
    close = spark.createDataFrame([(1.0, 1.0), (1.0, 0.5)], "a double, b double")
    # Uncentred: G = [[2, 1.5], [1.5, 1.25]], so a's is 2 * 1.25 / 0.25.
    assert [r.vif for r in statistics.variance_inflation(close, ["a", "b"]).collect()] == pytest.approx([10.0, 10.0])


_NODES, _EDGES = "hash string, type string, node_key string, x array<double>", "hash string, rel string, src_type string, src_key string, dst_type string, dst_key string, attr array<double>"


def _graph_rows(spark):
    nan = float("nan")
    nodes = [("a", "commit", "a", [1.0, 2.0]), ("a", "file", "f", [1.0]), ("a", "file", "g", [nan]), ("b", "commit", "b", [1.0]), ("b", "file", "f", None), ("d", "commit", "d", [0.0, None])]
    edges = [("a", "has", "commit", "a", "file", "f", []), ("a", "has", "commit", "a", "file", "f", []), ("a", "has", "commit", "a", "commit", "f", []), ("b", "has", "commit", "b", "file", None, []), ("b", "has", "commit", "", "file", "f", []), ("c", "has", "commit", "c", "file", "f", [])]
    commits = [("a", 1, "r"), ("b", 0, ""), ("c", 1, "r"), ("x", 1, None)]
    return spark.createDataFrame(nodes, _NODES), spark.createDataFrame(edges, _EDGES), spark.createDataFrame(commits, "hash string, label int, repo_url string")


_FOUND = {"width": 1, "not_finite": 2, "empty_end": 2, "dangling": 5, "too_many_nodes": 1, "no_repository": 2, "other_label": 2}


def test_graph_problems_by_hand(spark):
    nodes, edges, commits = _graph_rows(spark)
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("d", 0), ("c", 0)], "hash string, label int")
    found = audits.graph_problems(nodes, edges, {"commit": 2, "file": 1}, 2, commits, labels)
    assert {r.problem: r.n for r in found.collect()} == _FOUND
    per = {r.hash: (r.n_nodes, r.n_edges, r.dangling) for r in audits.graph_counts(nodes, edges).collect()}
    assert per == {"a": (3, 3, 1), "b": (2, 2, 2), "c": (0, 1, 2), "d": (1, 0, 0)}
    empty = audits.graph_problems(nodes.limit(0), edges.limit(0), 2, 2, commits, labels)
    assert {r.n for r in empty.collect()} == {0}
    plan = audits.graph_counts(nodes, edges)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "x#" not in plan.split("Exchange")[0]


def test_published_graphs_are_audited_while_written(spark, tmp_path):
    nodes, edges, commits = _graph_rows(spark)
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("d", 0), ("c", 0)], "hash string, label int")
    rejected = spark.createDataFrame([("x", "no_code_rows")], "hash string, reason string")
    found = api.publish_graphs(nodes, edges, commits, str(tmp_path / "g"), {"commit": 2, "file": 1}, 2, labels, rejected)
    assert {r.problem: r.n for r in found.collect()} == _FOUND
    listed = {r.hash: (r.label, r.repo_url, r.n_nodes, r.n_edges) for r in spark.read.parquet(str(tmp_path / "g/manifest")).collect()}
    assert listed == {"a": (1, "r", 3, 3), "b": (0, "", 2, 2), "c": (1, "r", 0, 1), "x": (1, None, 0, 0)}
    assert spark.read.json(str(tmp_path / "g/rejected")).first().reason == "no_code_rows"
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == edges.count()
    none = api.publish_graphs(nodes.where("false"), edges.where("false"), commits, str(tmp_path / "e"), 2)
    assert {r.n for r in none.collect()} == {0}


def test_graph_errors_by_hand(spark):
    nodes, edges, commits = _graph_rows(spark)
    files = spark.createDataFrame([("a",), ("a",), ("b",), ("x",)], "hash string")
    nodes = nodes.unionByName(spark.createDataFrame([("a", "developer", "e", [1.0, 0.0])], _NODES))
    found = audits.graph_errors(nodes, edges, commits.unionByName(spark.createDataFrame([(None, 1, "r")], commits.schema)), {"file": files}, {"has": "in"}, {"developer": 1})
    assert {r.hash: r.errors for r in found.collect()} == {
        "a": "no_author_edge,back_has,zero_embedding_developer", "b": "no_developer,no_author_edge,back_has", "c": "missing_graph,no_developer,no_author_edge,back_has",
        "x": "missing_graph,count_file,no_developer,no_author_edge", None: "missing_graph,no_developer,no_author_edge",
    }
