"""Edge tables of the change graph: (hash, src_key, dst_key, attr) with attr an array of doubles, and pieces of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import AUTHOR_EDGE_V2, EDGE_FEATURES, FILE_CHANGES, FUNCTION_CHANGES, ISSUE_EDGE_V2, LOGGED_COUNTS, TAG_EDGE_V2, bot_flag, capped_ratio, feature_vector, normal_key, one_hot, safe_double
from .cleaning import keep_first


def with_reverse(edges: DataFrame, relation: str, reverse: str) -> DataFrame:
    """Both directions with equal attributes, told apart by ``rel``."""
    swapped = {"src_key": "dst_key", "dst_key": "src_key"}
    back = edges.select(*[F.col(swapped.get(c, c)).alias(c) for c in edges.columns])
    return edges.withColumn("rel", F.lit(relation)).unionByName(back.withColumn("rel", F.lit(reverse)))


def star(nodes: DataFrame) -> DataFrame:
    """commit to each node, without attributes."""
    return nodes.select("hash", F.col("hash").alias("src_key"), F.col("node_key").alias("dst_key"), F.expr("cast(array() as array<double>)").alias("attr"))


def commit_file_changes(files: DataFrame, nan_paths: bool = False, commits: DataFrame | None = None) -> DataFrame:
    """10 values: change type, shares of the commit's added, deleted and method lines (at most 1), whether the path changed.

    With ``commits`` the added and deleted lines are over that table's totals, without limit. With ``nan_paths`` a missing path differs
    from any other; without it, it counts as unchanged."""
    w = Window.partitionBy("hash")
    rows = keep_first(files, ["hash", "filename"], ["change_type"])
    shares = [capped_ratio(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.coalesce(F.sum(c).over(w).cast("double"), F.lit(0.0))) if c in rows.columns else F.lit(0.0) for c in ("num_lines_added", "num_lines_deleted", "num_method_changed")]
    moved = F.lit(0.0)
    if "old_path" in rows.columns:
        differ = ~F.col("old_path").eqNullSafe(F.col("new_path"))
        moved = (differ if nan_paths else differ & F.col("old_path").isNotNull() & F.col("new_path").isNotNull()).cast("double")
    if commits is not None:
        rows = rows.join(commits.select("hash", *[safe_double(commits, c).alias(f"_{c}") for c in ("num_lines_added", "num_lines_deleted")]), "hash")
        shares[:2] = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / F.greatest(F.col(f"_{c}"), F.lit(1.0)) for c in ("num_lines_added", "num_lines_deleted")]
    attr = F.concat(one_hot(F.upper("change_type"), FILE_CHANGES, "UNKNOWN"), F.array(*shares, moved))
    return rows.select("hash", F.col("hash").alias("src_key"), F.col("filename").alias("dst_key"), attr.alias("attr"))


def commit_function(functions: DataFrame) -> DataFrame:
    """11 values, the first six always 0 as they leak the label, then the change type."""
    rows = keep_first(functions, ["hash", "filename", "name"], ["start_line"])
    kind = F.upper("function_change_type") if "function_change_type" in rows.columns else F.lit(None).cast("string")
    attr = F.concat(F.array_repeat(F.lit(0.0), 6), one_hot(kind, FUNCTION_CHANGES, "MODIFY"))
    return rows.select("hash", F.col("hash").alias("src_key"), F.concat_ws("::", "filename", "name").alias("dst_key"), attr.alias("attr"))


def file_function(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Files to their functions, by filename within the commit."""
    both = functions.select("hash", "filename", "name").distinct().join(files.select("hash", "filename").distinct(), ["hash", "filename"])
    return both.select("hash", F.col("filename").alias("src_key"), F.concat_ws("::", "filename", "name").alias("dst_key"))


def _n_parameters(functions: DataFrame, parsed: bool) -> Column:
    """Parameters of a function: the size of a list; of a written list the items where ``parsed``, else its characters."""
    kind = dict(functions.dtypes).get("parameters")
    if kind is None:
        return F.lit(0.0)
    if kind != "string":
        n = F.size("parameters")
    elif parsed:
        inside = F.regexp_replace("parameters", r"[\[\]\s]", "")
        n = F.when(inside == "", 0).otherwise(F.size(F.split(inside, ",")))
    else:
        n = F.length("parameters")
    return F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("double")


def file_function_shares(files: DataFrame, functions: DataFrame, by_lines: bool = False) -> DataFrame:
    """(hash, filename, name, attr): lines, complexity and tokens over the file's own (at most 1, 5 and 5), place in the file from 0 to 1 by
    start line, log number of parameters, and whether it is a snapshot before the change, and a hunk.

    ``by_lines``: 6 values instead: length, complexity and tokens over the file's without limit, start line over the file's lines, number
    of parameters, and whether it is a snapshot before the change."""
    own = ["num_lines_of_code", "complexity", "token_count"]
    totals = keep_first(files, ["hash", "filename"], ["change_type"]).select("hash", "filename", *[safe_double(files, c).alias(f"_{c}") for c in own])
    w = Window.partitionBy("hash", "filename")
    place = (F.row_number().over(w.orderBy("start_line", "name")) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))
    flag = lambda c: F.coalesce(F.col(c).cast("boolean").cast("double"), F.lit(0.0)) if c in functions.columns else F.lit(0.0)
    parameters = F.log1p(_n_parameters(functions, by_lines))
    rows = functions.join(totals, ["hash", "filename"])
    shares = [capped_ratio(safe_double(functions, c), F.col(f"_{c}"), cap) for c, cap in zip(own, (1.0, 5.0, 5.0), strict=True)]
    attr = [*shares, place, parameters, flag("before_change"), flag("is_hunk")]
    if by_lines:
        over = lambda a, b: safe_double(functions, a) / F.greatest(F.col(f"_{b}"), F.lit(1.0))
        attr = [over("length", "num_lines_of_code"), over("complexity", "complexity"), over("token_count", "token_count"), over("start_line", "num_lines_of_code"), F.expm1(parameters), flag("before_change")]
    return rows.select("hash", "filename", "name", F.array(*attr).alias("attr"))


def co_modified(functions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(hash, filename, a, b, nearness, likeness): both directions between the functions of a file in a commit:
    1 / (1 + line distance), and 1 - complexity difference over their sum.

    With ``files`` the other measure: the distance from the first one's first line to the other's last over the file's lines,
    and the difference over the larger complexity."""
    end = F.col("end_line").cast("double") if "end_line" in functions.columns else F.col("start_line").cast("double")
    rows = functions.select("hash", "filename", "name", F.col("start_line").cast("double").alias("s"), end.alias("e"), F.coalesce(F.col("complexity").cast("double"), F.lit(0.0)).alias("c"))
    a, b = rows.withColumnsRenamed({"name": "a", "s": "sa", "e": "ea", "c": "ca"}), rows.withColumnsRenamed({"name": "b", "s": "sb", "e": "eb", "c": "cb"})
    pairs = a.join(b, ["hash", "filename"]).where("a < b")
    near = 1 / (1 + F.abs(F.col("sa") - F.col("sb")))
    over = F.col("ca") + F.col("cb")
    if files is not None:
        lines = files.groupBy("hash", "filename").agg(F.max("num_lines_of_code").cast("double").alias("_n"))
        pairs = pairs.join(lines, ["hash", "filename"])
        gap = F.when(F.struct("sa", "a") < F.struct("sb", "b"), F.abs(F.col("sa") - F.col("eb"))).otherwise(F.abs(F.col("sb") - F.col("ea")))
        near = 1 / (1 + gap / F.greatest("_n", F.lit(1.0)))
        over = F.greatest("ca", "cb")
    like = 1 - F.abs(F.col("ca") - F.col("cb")) / F.greatest(over, F.lit(1.0))
    out = pairs.select("hash", "filename", "a", "b", near.alias("nearness"), like.alias("likeness"))
    return out.unionByName(out.select("hash", "filename", F.col("b").alias("a"), F.col("a").alias("b"), "nearness", "likeness"))


def commit_developer(roles: DataFrame, developers: DataFrame) -> DataFrame:
    """(hash, email, rel, is_bot): authored and committed edges to the developers of the commit."""
    named = roles.select(F.col("commit_hash").alias("hash"), normal_key(F.col("dev_id")).alias("email"), F.when(normal_key(F.col("role")) == "author", "authored_by").otherwise("committed_by").alias("rel")).distinct()
    return named.join(developers.select("hash", "email"), ["hash", "email"]).withColumn("is_bot", bot_flag(F.col("email")))


def commit_developer_v2(roles: DataFrame, developers: DataFrame, features: DataFrame) -> DataFrame:
    """(hash, email, rel, attr): the same edges with three features of the commit, zeros where it has none."""
    zero = F.array_repeat(F.lit(0.0), len(AUTHOR_EDGE_V2))
    known = keep_first(features, ["hash"], [c for c in AUTHOR_EDGE_V2 if c in features.columns]).select("hash", feature_vector(features, AUTHOR_EDGE_V2, ()).alias("attr"))
    return commit_developer(roles, developers).drop("is_bot").join(known, "hash", "left").withColumn("attr", F.coalesce("attr", zero))


def developer_file(matched: DataFrame, developers: DataFrame, order: str = "file_path") -> DataFrame:
    """(hash, email, filename, ratio, line_share, log_edits): ownership by the commit's developers, the first row of repeated ones by ``order``."""
    rows = matched.withColumn("email", normal_key(F.col("dev_email"))).withColumn("hash", F.col("commit_hash"))
    rows = keep_first(rows, ["hash", "email", "filename"], [order, F.desc("ownership_ratio")])
    share = capped_ratio(F.col("lines_owned"), F.col("total_lines"))
    return rows.join(developers.select("hash", "email"), ["hash", "email"]).select("hash", "email", "filename", F.col("ownership_ratio").alias("ratio"), share.alias("line_share"), F.log1p(F.col("edits_in_window").cast("double")).alias("log_edits"))


def commit_process(features: DataFrame, columns: list[str]) -> DataFrame:
    """commit to its aggregate process node, the features again as attributes."""
    attr = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    return features.select("hash", F.col("hash").alias("src_key"), F.lit("all").alias("dst_key"), attr.alias("attr"))


def commit_process_v2(features: DataFrame) -> dict[str, DataFrame]:
    """commit to its issue, pull-request and tag nodes: 3, 3 and 1 normalised features."""
    return {"has_issue": _process_star(features, ISSUE_EDGE_V2), "has_pr": _process_star(features, ISSUE_EDGE_V2), "has_release": _process_star(features, TAG_EDGE_V2)}


def _process_star(features: DataFrame, columns: list[str]) -> DataFrame:
    return features.select("hash", F.col("hash").alias("src_key"), F.lit("all").alias("dst_key"), feature_vector(features, columns, ()).alias("attr"))


def with_features(edges: DataFrame, features: DataFrame, name: str) -> DataFrame:
    """``edges`` (hash, src_key, dst_key) with the named relation's features of their commit as attributes; none where it has no features."""
    known = features.select("hash", feature_vector(features, EDGE_FEATURES[name], LOGGED_COUNTS).alias("attr"))
    return edges.drop("attr").join(known, "hash", "left").withColumn("attr", F.coalesce("attr", F.expr("cast(array() as array<double>)")))


def between_types(left: DataFrame, right: DataFrame, first_only: bool = False) -> DataFrame:
    """(hash, src_key, dst_key): each left node of a commit to each right one, or to the commit's first only.

    Meant for the few issues, pulls and tags of a commit; nodes are bounded by their per-commit limits."""
    targets = right.select("hash", F.col("node_key").alias("dst_key"))
    if first_only:
        targets = targets.groupBy("hash").agg(F.min("dst_key").alias("dst_key"))
    return left.select("hash", F.col("node_key").alias("src_key")).join(targets, "hash")


def time_chain(entities: DataFrame, key: str, times: list[str]) -> DataFrame:
    """(hash, src_key, dst_key): each entity to the next of its commit by the first of the columns ``times`` that the table has; entities
    without that time are left out."""
    found = [c for c in times if c in entities.columns]
    rows = entities.withColumn("_t", F.col(found[0]).try_cast("timestamp") if found else F.lit(None).cast("timestamp")).where("_t IS NOT NULL")
    following = F.lead(key).over(Window.partitionBy("hash").orderBy("_t", key))
    return rows.select("hash", F.col(key).alias("src_key"), following.alias("dst_key")).where("dst_key IS NOT NULL")


