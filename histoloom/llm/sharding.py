"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets.

Rows are range-partitioned in their final order. Each partition's total goes to the driver (one
row a partition), its exclusive prefix comes back as the partition's offset, and a running sum
inside each partition gives every row its global byte position. The middle of a row's byte range,
scaled to the shard count, is its shard: contiguous shards whose sizes differ by about one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import shuffle_partitions, written

OVERHEAD = 16


def _with_offsets(rows: DataFrame, totals: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    """Joins to ``rows`` the exclusive prefix of each sum in ``totals``, which has a row a partition (and shard)."""
    found = sorted((tuple(r[c] for c in by), [r[c] or 0 for c in sums]) for r in totals.collect())
    running, out = [0] * len(sums), []
    for key, values in found:
        out.append((*key, *running))
        running = [a + b for a, b in zip(running, values, strict=True)]
    schema = ", ".join([f"{c} int" for c in by] + [f"{c} long" for c in sums.values()])
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(out, schema)), by)


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of each row of ``docs``.

    Order: key with nulls first, then checksum and size, so repeated keys have a defined place
    and a much repeated key may span partitions. A null text has size 16 and a null checksum. An
    empty table gives an empty one. Other columns don't matter. ``grown_shard`` is null: another
    shard count moves every cut. The driver and the broadcasts get one row for each partition
    and shard that meet, at most partitions + shards.
    """
    spark = docs.sparkSession
    order = ["doc_key", "text_crc32", "size"]
    rows = docs.select(F.col(key).alias("doc_key"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    ranged = rows.repartitionByRange(partitions or shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "shard-rows")  # partition numbers are fixed from here on
    totals = ranged.groupBy("part").agg(F.sum("size").alias("size"))
    total = max(1, totals.agg(F.sum("size")).first()[0] or 0)
    in_part = Window.partitionBy("part").orderBy(*order)
    placed = _with_offsets(ranged, totals, ["part"], {"size": "before"}).withColumn("first_byte", F.col("before") + F.sum("size").over(in_part.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    middle = (F.col("first_byte") * 2 + F.col("size")).cast("decimal(38,0)") * shards
    placed = placed.withColumn("shard", F.least(F.floor(middle / F.lit(2 * total).cast("decimal(38,0)")).cast("int"), F.lit(shards - 1)))
    # A shard's rows in a partition are consecutive: their place is the shard's rows in partitions before, plus the row number here.
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("slot_before", F.coalesce(F.sum("n").over(starts), F.lit(0))).drop("n")
    in_piece = Window.partitionBy("part", "shard").orderBy(*order)
    return (
        placed.join(F.broadcast(counts), ["part", "shard"])
        .withColumn("slot", F.col("slot_before") + F.row_number().over(in_piece) - 1)
        .select(F.col("doc_key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
