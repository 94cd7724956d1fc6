"""Evolution edges kept up to date while commits come in batches, in any order.

State is append-only Parquet under one folder. ``snapshots/batch=i`` holds the rows that batch i brought, and ``edges/batch=i`` all edges
of every key that it touched, with one row of a key without any. The edges of a key are those of the last batch that touched it. A
batch that is repeated after a failure overwrites its own folders and nothing else. Both are partitioned by a bucket of the key,
so a batch reads the buckets of its keys alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.shared import written
from ..operators import history
from ..sources.tables import exists

#: Buckets of the keys, and so folders of a batch.
BUCKETS = 64
#: Takes snapshots that hold repo_url and author_date, and None for the commits; gives edges with src and the key.
Evolve = Callable[[DataFrame, None], DataFrame]


def _batches(spark: SparkSession, path: str, part: str, before: int | None = None) -> DataFrame | None:
    """The rows of all batches, or of those before one, with their batch's number."""
    if not exists(spark, f"{path}/{part}"):
        return None
    rows = spark.read.option("basePath", f"{path}/{part}").parquet(f"{path}/{part}/batch=*")
    return rows if before is None else rows.where(F.col("batch") < before)


def add_batch(rows: DataFrame, batch: int, path: str, key: Sequence[str] = ("repo_url", "filename"), evolve: Evolve = history.file_evolution, buckets: int = BUCKETS, within: Sequence[str] = ()) -> None:
    """Takes in ``rows``: hash, repo_url, author_date, the key and the measures of snapshots. Batches are numbered in the order in which they come, whatever
    their commits' dates; a commit between two known ones takes the place of the edge between them. Of rows of one commit and key (and of
    equal columns ``within``, such as the file of a function) in several batches the last one counts.

    Work grows with the history of the keys that the batch touches, not with all that is known."""
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    new = written(rows.withColumn("bucket", bucket), "batch")
    touched = new.select("bucket", *key).distinct()
    old = _batches(spark, path, "snapshots", batch)
    every = new.withColumn("batch", F.lit(batch))
    if old is not None:
        some = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        every = every.unionByName(old.where(F.col("bucket").isin(some)).join(touched, ["bucket", *key], "left_semi"), allowMissingColumns=True)
    # Rows are dealt once, by key: the last of a commit and the order in time are both within a key.
    last = Window.partitionBy("hash", *key, *within).orderBy(F.desc("batch"))
    known = every.repartition(*key).withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place", "batch", "bucket")
    edges = evolve(known, None).withColumns({"bucket": bucket, "is_edge": F.lit(True)})
    marks = touched.withColumn("is_edge", F.lit(False))
    out = edges.unionByName(marks, allowMissingColumns=True)
    for table, part in ((out, "edges"), (new, "snapshots")):  # a batch is known once its snapshots are
        table.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{part}/batch={batch}")


def current_edges(spark: SparkSession, path: str, key: Sequence[str] = ("repo_url", "filename")) -> DataFrame | None:
    """The edges after all batches, as ``evolve`` gives them, with the key; none before the first batch."""
    rows = _batches(spark, path, "edges")
    if rows is None:
        return None
    last = rows.where("NOT is_edge").groupBy("bucket", *key).agg(F.max("batch").alias("batch"))
    return rows.where("is_edge").join(last, ["bucket", *key, "batch"], "left_semi").drop("bucket", "batch", "is_edge")


def evolve_as_they_come(spark: SparkSession, folder: str, schema: str, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Takes in the Parquet files that come into ``folder``, each micro-batch under its own number."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream.writeStream.foreachBatch(lambda rows, batch: add_batch(rows, batch, path, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
