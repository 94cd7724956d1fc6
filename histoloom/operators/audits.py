"""Checks of splits, scalers, features and graph tables, as report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import md5_order, with_running_sums
from .statistics import melted

# Findings that a strategy implies.
BY_DESIGN = {"repo_overlap": ["temporal", "developer", "file", "function", "cwe", "severity", "hard_negatives", "graph_size"], "future_leak": ["repo", "developer", "file", "function", "cwe", "severity", "hard_negatives", "graph_size", "cold_start"]}


def split_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("repo_split").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"), F.avg("label").alias("pos_ratio"), F.count_distinct("repo_url").alias("n_repos"),
        F.date_format(F.min("author_date"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("author_date"), "yyyy-MM-dd").alias("last"),
    )


def in_several_splits(split: DataFrame) -> DataFrame:
    return split.groupBy("hash").agg(F.count_distinct("repo_split").alias("n_splits")).where("n_splits > 1")


def overlap(split: DataFrame, column: str, a: str = "train", b: str = "test") -> DataFrame:
    """Values of ``column`` in both parts."""
    part = lambda x: split.where(F.col("repo_split") == x).select(column)
    return part(a).intersect(part(b)).where(F.col(column).isNotNull())


def pair_overlaps(split: DataFrame, column: str) -> DataFrame:
    """(a, b, n): distinct values that each two parts share."""
    sets = split.select("repo_split", column).where(F.col(column).isNotNull()).distinct()
    both = sets.select(F.col("repo_split").alias("a"), column).join(sets.select(F.col("repo_split").alias("b"), column), column).where("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


def future_leak(split: DataFrame) -> DataFrame:
    """(n_train, n_future, share): train rows later than the earliest test row."""
    first = split.where("repo_split = 'test'").agg(F.min("author_date").alias("_first"))
    train = split.where("repo_split = 'train'").join(F.broadcast(first))
    late = F.coalesce(F.col("author_date") > F.col("_first"), F.lit(False))
    return train.agg(F.count("*").alias("n_train"), F.count_if(late).alias("n_future"), F.avg(late.cast("double")).alias("share"))


def split_problems(split: DataFrame, known: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """(problem, part): expected parts that are empty or without positives, and unknown parts."""
    spark = split.sparkSession
    wanted = spark.createDataFrame([(k,) for k in known], "part string")
    found = split.groupBy(F.col("repo_split").alias("part")).agg(F.count_if(F.col("label") == 1).alias("pos"))
    empty = wanted.join(found, "part", "left_anti").select(F.lit("empty").alias("problem"), "part")
    no_pos = found.where("pos = 0").join(wanted, "part", "left_semi").select(F.lit("no_positives").alias("problem"), "part")
    unknown = found.join(wanted, "part", "left_anti").select(F.lit("unknown").alias("problem"), "part")
    return empty.unionByName(no_pos).unionByName(unknown)


def verdicts(findings: DataFrame) -> DataFrame:
    """``findings`` (strategy, finding, n) with status: PASS at 0, BY-DESIGN where the strategy implies it, else FAIL."""
    expected = F.lit(False)
    for finding, strategies in BY_DESIGN.items():
        expected = expected | ((F.col("finding") == finding) & F.col("strategy").isin(strategies))
    return findings.withColumn("status", F.when(F.col("n") == 0, "PASS").when(expected, "BY-DESIGN").otherwise("FAIL"))


def label_conflicts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hash").agg(F.count_distinct("label").alias("n_labels"), F.count("*").alias("n_rows")).where("n_labels > 1 OR n_rows > 1")


def time_bounds(split: DataFrame) -> DataFrame:
    """(repo_split, first, last, n, n_before_train_end): rows of each part older than train's newest."""
    end = split.where("repo_split = 'train'").agg(F.max("author_date").alias("_end"))
    rows = split.join(F.broadcast(end))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.groupBy("repo_split").agg(day(F.min("author_date")).alias("first"), day(F.max("author_date")).alias("last"), F.count("*").alias("n"), F.count_if(F.coalesce(F.col("author_date") < F.col("_end"), F.lit(False))).alias("n_before_train_end"))


def expected_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(value, problem): missing and unexpected values of one-column tables."""
    e, a = expected.toDF("value"), actual.toDF("value")
    return e.exceptAll(a).distinct().withColumn("problem", F.lit("missing")).unionByName(a.exceptAll(e).distinct().withColumn("problem", F.lit("unexpected")))


def scaler_leaks(scaler: DataFrame, split: DataFrame) -> DataFrame:
    """(repo_url, parts): scaler repositories that aren't in train alone; unknown ones have no parts."""
    parts = split.groupBy("repo_url").agg(F.array_join(F.array_sort(F.collect_set("repo_split")), ",").alias("parts"))
    return scaler.select("repo_url").distinct().join(parts, "repo_url", "left").na.fill("", ["parts"]).where("parts <> 'train'")


def feature_auc(rows: DataFrame, columns: Sequence[str], scope: str = "repo_split") -> DataFrame:
    """(scope, column, auc, flagged): AUC of each single feature, folded to 0.5 or more, by part and over all; 0.5 for one class or a constant; above 0.7 flagged.

    Parts and the whole come from one melted table by grouping sets."""
    long = melted(rows, [scope, "label"], columns).where("value IS NOT NULL")
    counts = long.groupingSets([[scope, "column", "value"], ["column", "value"]], scope, "column", "value").agg(F.count("*").alias("t"), F.sum("label").alias("ones"), F.grouping(scope).alias("_g"))
    counts = counts.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(scope)).alias("scope"), "column", "value", "t", "ones")

    ranked = with_running_sums(counts, ["scope", "column"], [F.col("value")], {"t": "top"}).withColumn("rank", F.col("top") - (F.col("t") - 1) / 2)
    sums = ranked.groupBy("scope", "column").agg(F.sum("t").alias("n"), F.sum("ones").alias("n1"), F.sum(F.col("rank") * F.col("ones")).alias("r"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    raw = F.when((n1 > 0) & (n0 > 0), (F.col("r") - n1 * (n1 + 1) / 2) / (n1 * n0)).otherwise(0.5)
    auc = F.greatest(raw, 1 - raw)
    return sums.select("scope", "column", auc.alias("auc"), (auc > 0.7).alias("flagged"))


def column_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    v = F.col("value")
    return melted(rows, [], columns).groupBy("column").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.avg((v == 0).cast("double")).alias("zero_share"))


def domain_problems(rows: DataFrame, binary: Sequence[str] = (), ranges: dict[str, tuple[float, float]] | None = None, slack: float = 1e-5) -> DataFrame:
    """(check, column, n_bad): values that aren't 0 or 1, or lie outside a range."""
    checks = [F.struct(F.lit("binary").alias("check"), F.lit(c).alias("column"), F.count_if(~F.col(c).isin(0, 1)).alias("n_bad")) for c in binary]
    checks += [F.struct(F.lit("range").alias("check"), F.lit(c).alias("column"), F.count_if((F.col(c) < lo - slack) | (F.col(c) > hi + slack)).alias("n_bad")) for c, (lo, hi) in (ranges or {}).items()]
    return rows.agg(F.array(*checks).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def one_hot_problems(rows: DataFrame, vector: str, first: int, n: int) -> DataFrame:
    total = F.aggregate(F.slice(vector, first + 1, n), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.agg(F.count_if(F.abs(total - 1) > 1e-5).alias("n_bad"), F.count("*").alias("n"))


def norms(rows: DataFrame, vector: str) -> DataFrame:
    """(n, min_norm, max_norm, mean_norm, zero_share) of a vector column."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.select(norm.alias("n")).agg(F.count("*").alias("n_rows"), F.min("n").alias("min_norm"), F.max("n").alias("max_norm"), F.avg("n").alias("mean_norm"), F.avg((F.col("n") == 0).cast("double")).alias("zero_share"))


def coverage(commits: DataFrame, **tables: DataFrame) -> DataFrame:
    """(commit_type, label, has_<table>..., has_any, n): which tables have rows of a commit."""
    out = commits.select("hash", "commit_type", "label")
    for name, t in tables.items():
        key = "hash" if "hash" in t.columns else "commit_hash"
        out = out.join(t.select(F.col(key).alias("hash"), F.lit(True).alias(f"has_{name}")).distinct(), "hash", "left")
    flags = [f"has_{n}" for n in tables]
    out = out.na.fill(False, flags)
    any_ = F.lit(False)
    for f in flags:
        any_ = any_ | F.col(f)
    return out.withColumn("has_any", any_).groupBy("commit_type", "label", *flags, "has_any").agg(F.count("*").alias("n"))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def misaligned(features: DataFrame, index: DataFrame, order: str, keys: Sequence[str]) -> DataFrame:
    """Positions where two tables in the same order hold other keys, or only one has a row."""
    tag = lambda df, p: df.select(F.col(order).alias("_pos"), *[F.col(k).alias(f"{p}_{k}") for k in keys])
    both = tag(features, "a").join(tag(index, "b"), "_pos", "full")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    return both.where(~same)


def orphan_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return left.select(F.col(left_key).alias("key")).where("key IS NOT NULL").distinct().join(right.select(F.col(right_key).alias("key")), "key", "left_anti")


def stratified_sample(rows: DataFrame, n: int, seed: int = 42, stratum: str = "label", key: str = "hash") -> DataFrame:
    """``n`` rows of each stratum, the first in shuffled order: the first of 256 parts of it, then of those."""
    parts = F.pmod(F.xxhash64(key), F.lit(256))
    shuffled = md5_order(seed, key)
    first = rows.withColumn("_place", F.row_number().over(Window.partitionBy(stratum, parts).orderBy(*shuffled))).where(F.col("_place") <= n)
    return first.withColumn("_place", F.row_number().over(Window.partitionBy(stratum).orderBy(*shuffled))).where(F.col("_place") <= n).drop("_place")


def node_checks(width: int | dict[str, int]) -> dict[str, Column]:
    """Counts over node rows (x[, type]) that one pass gives: vectors of another width (``width``, or by type), and with bad numbers."""
    wanted = F.lit(width) if isinstance(width, int) else F.element_at(F.create_map(*[F.lit(v) for pair in width.items() for v in pair]), F.col("type"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return {"width": F.count_if(F.size("x") != wanted), "not_finite": F.count_if(bad)}


def edge_checks() -> dict[str, Column]:
    """Counts over edge rows that one pass gives: ends without a key."""
    empty = lambda c: F.count_if(F.col(c).isNull() | (F.col(c) == ""))
    return {"empty_end": empty("src_key") + empty("dst_key")}


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(hash, n_nodes, n_edges, dangling): the rows of each graph and its edge ends that no node has.

    Nodes and both ends of the edges meet in one tagged union, counted by key before they are dealt, so a key of many edges is one row
    a task, and no vector moves. Types count where the edges have them. An end with a null key dangles."""
    keys = ["hash", "node_key", *(["type"] if "src_type" in edges.columns else [])]
    side = lambda s, first: F.struct(F.col(f"{s}_key").alias("node_key"), *[F.col(f"{s}_type").alias("type") for _ in keys[2:]], F.lit(first).alias("_edge"))
    ends = edges.select("hash", F.explode(F.array(side("src", 1), side("dst", 0))).alias("_e")).select("hash", "_e.*").withColumn("_node", F.lit(0))
    rows = ends.unionByName(nodes.select(*keys, F.lit(0).alias("_edge"), F.lit(1).alias("_node")))
    by_key = rows.groupBy(*keys).agg(F.sum("_node").alias("n_nodes"), F.sum("_edge").alias("n_edges"), F.count_if(F.col("_node") == 0).alias("_ends"))
    absent = F.col("n_nodes") == 0
    for k in keys:
        absent = absent | F.col(k).isNull()
    return by_key.groupBy("hash").agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_edges").alias("n_edges"), F.sum(F.when(absent, F.col("_ends")).otherwise(0)).alias("dangling"))


def count_problems(counts: DataFrame, most: int = 100_000, commits: DataFrame | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """(problem, n) over :func:`graph_counts`: dangling ends, graphs of more than ``most`` nodes, with ``commits`` (hash, label, repo_url) graphs
    without a repository, with ``labelled`` (hash, label) also those that it gives another label.

    Commits and labels join the counts by one aggregation. A commit listed twice with different values counts if one of them is bad."""
    found = {"dangling": F.sum("dangling"), "too_many_nodes": F.count_if(F.col("n_nodes") > most)}
    rows = counts.select("hash", "n_nodes", "dangling")
    if commits is not None:
        listed = commits.where("hash IS NOT NULL").select("hash", F.lit("commit").alias("_from"), "label", (F.col("repo_url").isNull() | (F.col("repo_url") == "")).alias("_bare"))
        if labelled is not None:
            listed = listed.unionByName(labelled.where("hash IS NOT NULL").select("hash", F.lit("labels").alias("_from"), "label", F.lit(False).alias("_bare")))
        rows = rows.unionByName(listed, allowMissingColumns=True).groupBy("hash").agg(
            F.sum("n_nodes").alias("n_nodes"), F.sum("dangling").alias("dangling"), F.count_if(F.col("_from") == "commit").alias("_c"), F.count_if(F.col("_from") == "labels").alias("_l"),
            F.count_if("_bare").alias("_bare"), F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("label").alias("_known"),
        )
        graph = F.col("n_nodes") > 0
        found["no_repository"] = F.count_if(graph & ((F.col("_c") == 0) | (F.col("_bare") > 0)))
        if labelled is not None:  # a graph without a commit has a null label
            same = F.col("_low").eqNullSafe(F.col("_high")) & ((F.col("_known") == 0) | ((F.col("_known") == F.col("_c") + F.col("_l")) & (F.col("_c") > 0)))
            found["other_label"] = F.count_if(graph & (F.col("_l") > 0) & ~same)
    return _stacked(rows, found)


def _stacked(rows: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """(problem, n): one row a count, all of one pass."""
    one = rows.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in counts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("problem"), F.col(name).alias("n")) for name in counts])).alias("_p")).select("_p.*")


def graph_problems(nodes: DataFrame, edges: DataFrame, width: int | dict[str, int], most: int = 100_000, commits: DataFrame | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """(problem, n) over node rows (hash, node_key, x[, type]) and edge rows (hash, src_key, dst_key[, src_type, dst_type]): those of
    :func:`node_checks`, :func:`edge_checks` and :func:`count_problems`. Each table is read for its own columns' pass and for one union by key."""
    out = _stacked(nodes, node_checks(width)).unionByName(_stacked(edges, edge_checks()))
    return out.unionByName(count_problems(graph_counts(nodes, edges), most, commits, labelled))


def graph_errors(nodes: DataFrame, edges: DataFrame, commits: DataFrame, tables: dict[str, DataFrame], backward: dict[str, str], embedded: dict[str, int] | None = None) -> DataFrame:
    """(hash, errors): of each commit's graph, in this order: missing_graph; count_<type> where the source table of a node type has
    another number of rows (``tables``: type to hash rows); no_developer; no_author_edge; back_<rel> where a relation and its reverse in
    ``backward`` differ in number; zero_embedding_<type> where all of a type's vectors are 0 from a dim on (``embedded``).

    All rows meet in one tagged union, counted by commit before they are dealt; of a vector only its weight goes along, and of the edges those
    relations that a check counts."""
    tagged = lambda df, kind, name, weight=F.lit(None).cast("double"): df.select("hash", F.lit(kind).alias("_from"), name.cast("string").alias("_name"), weight.alias("_w"))
    weight = F.lit(None).cast("double")
    for kind, first in (embedded or {}).items():
        of_kind = F.aggregate(F.slice("x", first + 1, F.greatest(F.size("x") - first, F.lit(0))), F.lit(0.0), lambda a, v: a + F.abs(v))
        weight = F.when(F.col("type") == kind, of_kind).otherwise(weight)
    counted = edges.where(F.col("rel").isin("authored_by", *backward, *backward.values()))
    rows = tagged(commits, "commit", F.lit("")).unionByName(tagged(nodes, "node", F.col("type"), weight)).unionByName(tagged(counted, "edge", F.col("rel")))
    for kind, table in tables.items():
        rows = rows.unionByName(tagged(table, "table", F.lit(kind)))
    is_ = lambda kind, name: (F.col("_from") == kind) & (F.col("_name") == name)
    number: dict[tuple[str, str], str] = {}
    for pair in [("node", "developer"), ("edge", "authored_by"), *[(side, k) for k in tables for side in ("node", "table")], *[("edge", r) for both in backward.items() for r in both]]:
        number.setdefault(pair, f"_n{len(number)}")
    sums = [F.count_if(is_(*pair)).alias(name) for pair, name in number.items()] + [F.max(F.when(is_("node", k), F.col("_w"))).alias(f"_w_{k}") for k in embedded or {}]
    per = rows.groupBy("hash").agg(F.count_if(F.col("_from") == "commit").alias("_commits"), F.count_if(F.col("_from") == "node").alias("_nodes"), *sums)
    own = lambda kind, name: F.when(F.col("hash").isNotNull(), F.col(number[kind, name])).otherwise(0)
    checks = [F.when((F.col("_nodes") == 0) | F.col("hash").isNull(), "missing_graph")]
    checks += [F.when(own("node", k) != own("table", k), f"count_{k}") for k in tables]
    checks.append(F.when(own("node", "developer") == 0, "no_developer"))
    checks.append(F.when(own("edge", "authored_by") == 0, "no_author_edge"))
    checks += [F.when(own("edge", rel) != own("edge", back), f"back_{rel}") for rel, back in backward.items()]
    checks += [F.when((F.col(f"_w_{k}") == 0) & F.col("hash").isNotNull(), f"zero_embedding_{k}") for k in embedded or {}]
    errors = F.filter(F.array(*checks), lambda c: c.isNotNull())
    return per.where("_commits > 0").select("hash", F.array_join(errors, ",").alias("errors")).where("errors <> ''")


def integration(graph_counts: DataFrame, raw_counts: DataFrame, key: str = "hash") -> DataFrame:
    """(key, errors): where counts in the graph tables and in the source differ, by count column."""
    names = [c for c in graph_counts.columns if c != key]
    g, r = graph_counts.toDF(key, *[f"g_{c}" for c in names]), raw_counts.select(key, *[F.col(c).alias(f"r_{c}") for c in names])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    errors = F.filter(F.array(*[F.when(zero(f"g_{c}") != zero(f"r_{c}"), F.lit(c)) for c in names]), lambda x: x.isNotNull())
    return g.join(r, key, "full").select(key, F.array_join(errors, ",").alias("errors")).where("errors <> ''")


