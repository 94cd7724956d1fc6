"""Keyed stores: tables bucketed and sorted by key, so that joins on it leave their rows where they are and one key is read from one bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nodes import last_vectors

EMBEDDING_KEYS = ("hash", "name", "filename")


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, keys: Sequence[str], sort: Sequence[str] = (), parts: Sequence[str] = ()) -> DataFrame:
    """``df`` as the table ``name`` under ``path``, dealt by ``keys`` to as many buckets, each sorted; ``parts`` are partition columns.

    Rows are dealt as the buckets are, so a task writes one bucket and a partition has one file of each."""
    writer = df.repartition(buckets, *keys).write.format("parquet").mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *sort).option("path", path)
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
    return _opened(df.sparkSession, name, buckets)


def _opened(spark: SparkSession, name: str, buckets: int) -> DataFrame:
    """The table, with a mark by which joins deal the other side as the buckets are."""
    table = spark.table(name)
    table._buckets = buckets
    return table


def open_bucketed(spark: SparkSession, name: str, path: str, schema: str, buckets: int, keys: Sequence[str], sort: Sequence[str] = (), parts: Sequence[str] = ()) -> DataFrame:
    """A table of :func:`write_bucketed` made known to a session whose catalogue has not seen it."""
    listed = lambda names: ", ".join(f"`{n}`" for n in names)
    place = path.replace("'", "\\'")
    by = f"PARTITIONED BY ({listed(parts)}) " if parts else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet {by}CLUSTERED BY ({listed(keys)}) SORTED BY ({listed([*keys, *sort])}) INTO {buckets} BUCKETS LOCATION '{place}'")
    if parts:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return _opened(spark, name, buckets)


def write_embeddings(rows: DataFrame, name: str, path: str, buckets: int = 64, keys: Sequence[str] = EMBEDDING_KEYS) -> DataFrame:
    """(keys, emb or vec_id) of ``rows`` (keys, emb or vec_id, seq): the last row of a key by ``seq`` wins, once and for all joins to come."""
    return write_bucketed(last_vectors(rows, keys), name, path, buckets, keys)


def write_graph_store(nodes: DataFrame, edges: DataFrame, name: str, path: str, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """The tables ``name_nodes`` and ``name_edges``, a folder a type or relation, bucketed by the commit's hash."""
    return write_bucketed(nodes, f"{name}_nodes", f"{path}/nodes", buckets, ["hash"], ["node_key"], ["type"]), write_bucketed(edges, f"{name}_edges", f"{path}/edges", buckets, ["hash"], ["src_key", "dst_key"], ["rel"])


def graph_of(spark: SparkSession, name: str, hash_: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one commit: one bucket of each is read."""
    return tuple(spark.table(f"{name}_{part}").where(F.col("hash") == hash_) for part in ("nodes", "edges"))
