"""Per-repository scaling and feature masks over long rows (hash, group, repo_url, dim, value) or vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.vectors import vector_moments
from .graphs import without_types

# Named masks as type (of a node, or a relation), first and last dim; -1 is the vector's last.
MASKS = {
    "code_embedding": [("function", -768, -1)], "hunk_embedding": [("hunk", -768, -1)], "message_embedding": [("commit", -768, -1)], "code_before_embedding": [("function", 776, -1)],
    "function_metrics": [("function", 0, 4)], "file_metrics": [("file", 0, 2)], "hunk_metrics": [("hunk", 0, 1)], "merge_flag": [("commit", 1, 1)], "dmm": [("commit", 2, 4)],
    "function_change_type": [("modifies_func", 6, 10), ("in_commit_fn", 6, 10)], "process": [("issue", 0, -1), ("pull_request", 0, -1), ("release_tag", 0, -1)], "developer_features": [("developer", 0, -1)],
    "developer": [("developer", 0, -1), ("authored_by", 0, -1), ("authored", 0, -1), ("committed_by", 0, -1), ("committed", 0, -1), ("owns", 0, -1), ("owned_by", 0, -1)],
    "pruned": [("function", 0, 0), ("issue", 0, 0), ("issue", 2, 2), ("pull_request", 0, 0), ("pull_request", 2, 2), ("release_tag", 0, 0), ("release_tag", 3, 3), ("developer", 6, 6), ("commit", 2, 2), ("commit", 5, 5), ("commit", 6, 6)],
    "pruned_v2": [("function", 3, 3), ("release_tag", 1, 1), ("developer", 5, 5), ("developer", 7, 7), ("developer", 8, 8), ("commit", 3, 3), ("commit", 4, 4), ("commit", 7, 7), ("commit", 10, 10), ("pull_request", 3, 3)],
    "keep_developer_only": [("issue", 0, -1), ("pull_request", 0, -1), ("release_tag", 0, -1), ("has_issue", 0, -1), ("has_pr", 0, -1), ("linked_to_commit", 0, -1), ("has_release", 0, -1), ("release_of", 0, -1)],
    "keep_process_only": [("developer", 0, -1), ("authored_by", 0, -1), ("authored", 0, -1), ("committed_by", 0, -1), ("committed", 0, -1)],
    "keep_edges_only": [("developer", 0, -1), ("issue", 0, -1), ("pull_request", 0, -1), ("release_tag", 0, -1)],
    "keep_nodes_only": [("authored_by", 0, -1), ("authored", 0, -1), ("committed_by", 0, -1), ("committed", 0, -1), ("has_issue", 0, -1), ("has_pr", 0, -1), ("linked_to_commit", 0, -1), ("has_release", 0, -1), ("release_of", 0, -1)],
}
# Configurations as names of masks, and node types left out.
CONFIGURATIONS = {
    "full_model": ([], []), "no_code_emb": (["code_embedding"], []), "no_msg_emb": (["message_embedding"], []), "no_sdlc": (["process"], []), "no_fn_categorical": (["function_change_type"], []),
    "no_embeddings": (["code_embedding", "message_embedding"], []), "no_developer": (["developer"], []), "no_hunk": ([], ["hunk"]), "shap_minimal": (["hunk_metrics", "merge_flag"], []),
}
#: Masks that every configuration carries.
BASE_MASKS = ["function_metrics", "file_metrics"]


def fit_scaler(rows: DataFrame, split: DataFrame, least: int = 10) -> DataFrame:
    """(group, repo_url, dim, mean, std, n) over the train commits alone: population deviation, at least 1e-6; groups with
    fewer than ``least`` rows have none. ``rows``: hash, repo_url, group, x; a vector with a bad number is left out whole."""
    train = rows.join(split.where("repo_split = 'train'").select("hash").distinct(), "hash", "left_semi")
    good = train.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    fit = vector_moments(good, ["group", "repo_url"]).where(F.col("n") >= least)
    return fit.select("group", "repo_url", "dim", "mean", F.sqrt(F.greatest("variance", F.lit(1e-12))).alias("std"), "n")


def scaler_vectors(scaler: DataFrame) -> DataFrame:
    """(group, repo_url, means, stds): one row a repository and group, arrays by dim with nulls where a dim has no entry."""
    found = scaler.groupBy("group", "repo_url").agg(F.map_from_entries(F.collect_list(F.struct("dim", F.struct("mean", "std")))).alias("_scale"), F.max("dim").alias("_last"))
    at = lambda name: F.transform(F.sequence(F.lit(0).cast("long"), F.col("_last")), lambda i: F.element_at("_scale", i)[name])
    return found.select("group", "repo_url", at("mean").alias("means"), at("std").alias("stds"))


def apply_scaler(rows: DataFrame, scaler: DataFrame) -> DataFrame:
    """``rows`` with x scaled by its repository's dims; unknown repositories and dims stay as they are."""
    wide = rows.join(scaler_vectors(scaler), ["group", "repo_url"], "left")
    scaled = F.transform("x", lambda v, i: F.coalesce((v - F.get("means", i)) / F.get("stds", i), v))
    return wide.withColumn("x", F.when(F.col("means").isNull(), F.col("x")).otherwise(scaled)).drop("means", "stds")


def mask_table(spark, masks: Sequence[tuple[str, int, int]]) -> DataFrame:
    """(type, first, last) of the dims to be zeroed; negative ones count from a vector's end."""
    rows = [Row(type=t, first=a, last=b) for t, a, b in masks]
    return spark.createDataFrame(rows or [], "type string, first int, last int")


def named_mask(spark, *names: str) -> DataFrame:
    """The dims of named masks; ``type:dim`` names a single one."""
    found: list[tuple[str, int, int]] = []
    for name in names:
        if ":" in name:
            kind, dim = name.rsplit(":", 1)
            found.append((kind, int(dim), int(dim)))
        else:
            found += MASKS[name]
    return mask_table(spark, found)


def _stretch(part: Column, size: Column) -> tuple[Column, Column]:
    """First and last dim of a mask in a vector of that size. A mask from the end, such as an embedding's tail, is below 0 in shorter vectors."""
    at = lambda c: F.when(c < 0, size + c).otherwise(c)
    return at(part["first"]), at(part["last"])


def apply_mask(rows: DataFrame, mask: DataFrame, type_: Column | str = "type", vector: str = "x") -> DataFrame:
    """The masked dims of each type's vectors become 0. A mask from the end, such as an embedding's tail, leaves shorter vectors alone.

    Each stretch of a mask is put in whole, between the slices before and after it."""
    stretches = mask.groupBy(F.col("type").alias("_type")).agg(F.collect_list(F.struct("first", "last")).alias("_parts"))
    wide = rows.join(F.broadcast(stretches), (F.col(type_) if isinstance(type_, str) else type_) == F.col("_type"), "left")
    n, x = F.size(vector), F.col(vector).cast("array<double>")

    def zeroed(v: Column, part: Column) -> Column:
        first, last = _stretch(part, n)
        last = F.least(last, n - 1)
        return F.when((first >= 0) & (first <= last), F.concat(F.slice(v, F.lit(1), first), F.array_repeat(F.lit(0.0), last - first + 1), F.slice(v, last + 2, n))).otherwise(v)

    return wide.withColumn(vector, F.when(F.col("_parts").isNull(), x).otherwise(F.reduce("_parts", x, zeroed))).drop("_type", "_parts")


def values_left(rows: DataFrame, masks: dict[str, DataFrame], type_: str = "type", vector: str = "x") -> DataFrame:
    """(mask, type, dim, n): how many values other than 0 are left by each of several masks, zeros included.

    A mask treats vectors of a type and size alike, so values are counted once by type, size and dim, and the masks are laid over the counts."""
    long = rows.select(F.col(type_).alias("type"), F.size(vector).alias("_size"), F.posexplode(vector).alias("_dim", "_value"))
    counts = long.groupBy("type", "_size", F.col("_dim").cast("long").alias("dim")).agg(F.count_if(F.col("_value") != 0).alias("n"))
    parts = None
    for name, mask in masks.items():
        part = mask.select(F.lit(name).alias("mask"), "type", F.struct("first", "last").alias("_part"))
        parts = part if parts is None else parts.unionByName(part)
    stretches = parts.groupBy("mask", "type").agg(F.collect_list("_part").alias("_parts"))
    names = F.explode(F.array(*[F.lit(name) for name in masks])).alias("mask")
    wide = counts.select("*", names).join(F.broadcast(stretches), ["mask", "type"], "left")

    def covers(part: Column) -> Column:
        first, last = _stretch(part, F.col("_size"))
        return (first >= 0) & F.col("dim").between(first, last)

    gone = F.coalesce(F.exists("_parts", covers), F.lit(False))
    return wide.groupBy("mask", "type", "dim").agg(F.sum(F.when(gone, 0).otherwise(F.col("n"))).alias("n"))


def apply_named(nodes: DataFrame, edges: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """Named masks on node vectors by type and on edge attributes by relation."""
    mask = named_mask(nodes.sparkSession, *names)
    return apply_mask(nodes, mask), apply_mask(edges, mask, "rel", "attr")


def configured(nodes: DataFrame, edges: DataFrame, name: str, base: Sequence[str] = BASE_MASKS) -> tuple[DataFrame, DataFrame]:
    """A named configuration: its masks and the base ones, and without the node types that it leaves out."""
    masks, types = CONFIGURATIONS[name]
    return apply_named(*without_types(nodes, edges, types), *base, *masks)


def keep_only(rows: DataFrame, types: Sequence[str], vector: str = "x") -> DataFrame:
    """The vectors of all other types become zeros."""
    return rows.withColumn(vector, F.when(F.col("type").isin(*types), F.col(vector)).otherwise(F.transform(vector, lambda _: F.lit(0.0))))


def coalitions(spark, groups: Sequence[str]) -> DataFrame:
    """(mask, group, present) for all 2^K subsets of ``groups``."""
    bits = [F.struct(F.lit(g).alias("group"), (F.shiftright("mask", i).bitwiseAND(1) == 1).alias("present")) for i, g in enumerate(groups)]
    return spark.range(1 << len(groups)).select(F.col("id").alias("mask")).select("mask", F.explode(F.array(*bits)).alias("_b")).select("mask", "_b.group", "_b.present")
