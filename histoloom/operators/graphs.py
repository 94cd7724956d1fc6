"""Operations on node tables (hash, type, node_key, x) and edge tables (hash, rel, src_type, src_key, dst_type, dst_key, attr)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import BLOCK, PLACES, blocks


def graph_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(hash, kind, type, n): nodes by type and edges by relation of each graph."""
    n = nodes.groupBy("hash", "type").agg(F.count("*").alias("n")).select("hash", F.lit("node").alias("kind"), "type", "n")
    e = edges.groupBy("hash", F.col("rel").alias("type")).agg(F.count("*").alias("n")).select("hash", F.lit("edge").alias("kind"), "type", "n")
    return n.unionByName(e)


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n): nodes by type and edges by relation over all graphs, counted before any row moves."""
    n = nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    e = edges.groupBy(F.col("rel").alias("type")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n")
    return n.unionByName(e)


def manifest(commits: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(hash, label, repo_url, n_nodes, n_edges)."""
    n, e = nodes.groupBy("hash").agg(F.count("*").alias("n_nodes")), edges.groupBy("hash").agg(F.count("*").alias("n_edges"))
    return commits.select("hash", "label", "repo_url").join(n, "hash", "left").join(e, "hash", "left").na.fill(0, ["n_nodes", "n_edges"])


def without_types(nodes: DataFrame, edges: DataFrame, types: Sequence[str] = (), relations: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Node types dropped together with the edges that touch them, and named relations; commits can't be dropped."""
    if "commit" in types:
        raise ValueError("the commit node can't be dropped")
    kept = edges.where(~F.col("src_type").isin(*types) & ~F.col("dst_type").isin(*types)) if types else edges
    return (nodes.where(~F.col("type").isin(*types)) if types else nodes), (kept.where(~F.col("rel").isin(*relations)) if relations else kept)


def with_attributes(edges: DataFrame, width: int) -> DataFrame:
    """Missing or empty attributes become ``width`` zeros."""
    return edges.withColumn("attr", F.when(F.size(F.coalesce("attr", F.expr("cast(array() as array<double>)"))) > 0, F.col("attr")).otherwise(F.array_repeat(F.lit(0.0), width)))


def with_extra(nodes: DataFrame, extra: DataFrame, width: int, keys: Sequence[str] = ("hash", "node_key")) -> DataFrame:
    """``extra`` (keys, emb) appended to the vectors, zeros where none is known."""
    wide = nodes.join(extra, list(keys), "left")
    return wide.withColumn("x", F.concat("x", F.coalesce(F.col("emb").cast("array<double>"), F.array_repeat(F.lit(0.0), width)))).drop("emb")


def _blocks(nodes: DataFrame) -> DataFrame:
    return blocks(nodes, ["hash", "type", "node_key"])


def _passed_on(cut: DataFrame, edges: DataFrame) -> DataFrame:
    """The blocks at the targets: for each relation the mean of the sources', summed over relations."""
    src = cut.withColumnsRenamed({"type": "src_type", "node_key": "src_key"})
    flow = edges.select("hash", "rel", "src_type", "src_key", "dst_type", "dst_key").join(src, ["hash", "src_type", "src_key"])
    means = flow.groupBy("hash", "rel", "dst_type", "dst_key", "_block").agg(F.max("_width").alias("_width"), *[F.avg(p).alias(p) for p in PLACES])
    return means.groupBy("hash", F.col("dst_type").alias("type"), F.col("dst_key").alias("node_key"), "_block").agg(F.max("_width").alias("_width"), *[F.sum(p).alias(p) for p in PLACES])


def _long(cut: DataFrame) -> DataFrame:
    """(hash, type, node_key, dim, value) of blocks, without places that no source has."""
    places = cut.select("hash", "type", "node_key", "_block", F.posexplode(F.array(*PLACES)).alias("_i", "value")).where("value IS NOT NULL")
    return places.select("hash", "type", "node_key", (F.col("_block") * BLOCK + F.col("_i")).cast("long").alias("dim"), "value")


def neighbour_vectors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(hash, type, node_key, x): for each relation the mean of the source vectors at a target, summed over relations.

    Vectors travel in blocks of eight places, whose means are plain columns, and are put together at the end. A null inside a vector counts as
    absent and keeps the places of the others; a place that no source has is null. A target all of whose sources have empty vectors has no row."""
    found = _passed_on(_blocks(nodes), edges).groupBy("hash", "type", "node_key").agg(F.max("_width").alias("_width"), F.sort_array(F.collect_list(F.struct("_block", F.array(*PLACES).alias("_v")))).alias("_parts"))
    # A source that is shorter than another has no later blocks, but the longest has all of them.
    return found.select("hash", "type", "node_key", F.slice(F.flatten(F.col("_parts._v")), F.lit(1), F.col("_width")).alias("x"))


def neighbour_means(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(hash, type, node_key, dim, value) of :func:`neighbour_vectors`, without places that no source has."""
    return _long(_passed_on(_blocks(nodes), edges))


def commit_readout(nodes: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(hash, dim, value) at the commit after one or two rounds of neighbour means."""
    cut = _blocks(nodes)
    for _ in range(hops):
        cut = _passed_on(cut, edges)
    return _long(cut).where("type = 'commit'").select("hash", "dim", "value")


def graph_mean(values: DataFrame, graphs: DataFrame) -> DataFrame:
    """(hash, mean): mean of the values of each graph, 0 for a graph without any."""
    return graphs.select("hash").join(values.groupBy("hash").agg(F.avg("value").alias("mean")), "hash", "left").na.fill(0.0, ["mean"])


def _chance(seed: int, *parts: str | Column) -> Column:
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *columns).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mask_types(nodes: DataFrame, p: float, seed: int, types: Sequence[str]) -> DataFrame:
    """All vectors of a node type in a graph become zeros with probability ``p``, the same for every run with the seed."""
    hit = F.col("type").isin(*types) & (_chance(seed, "hash", "type") < p)
    return nodes.withColumn("x", F.when(hit, F.transform("x", lambda _: F.lit(0.0))).otherwise(F.col("x")))


def drop_edges(edges: DataFrame, p: float, seed: int) -> DataFrame:
    """Edges dropped with probability ``p``; both directions of an edge share their fate."""
    a, b = F.concat_ws(":", "src_type", "src_key"), F.concat_ws(":", "dst_type", "dst_key")
    return edges.where(_chance(seed, "hash", F.least(a, b), F.greatest(a, b)) >= p)


def named_edges(edges: DataFrame, nodes: DataFrame, categories: Sequence[str], first: int, gap: int) -> DataFrame:
    """(hash, rel, src_key, dst_key, kind, days): edges with both ends known, the name of the largest of a one-hot slice, and the days of a log gap."""
    known = nodes.select("hash", "type", "node_key")
    ends = edges.join(known.toDF("hash", "src_type", "src_key"), ["hash", "src_type", "src_key"], "left_semi").join(known.toDF("hash", "dst_type", "dst_key"), ["hash", "dst_type", "dst_key"], "left_semi")
    part = F.slice("attr", first + 1, len(categories))
    kind = F.element_at(F.array(*[F.lit(c) for c in categories]), F.array_position(part, F.array_max(part)).cast("int"))
    return ends.select("hash", "rel", "src_key", "dst_key", kind.alias("kind"), F.round(F.expm1(F.element_at("attr", gap + 1))).cast("long").alias("days"))
