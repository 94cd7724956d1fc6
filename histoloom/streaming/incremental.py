"""Incremental graph building: new commits are picked up from a folder as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import exists, to_build


def build_as_they_come(spark: SparkSession, folder: str, schema: str, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Reads the Parquet files that come into ``folder``, builds the commits not in ``out`` yet, and appends them there.

    Each micro-batch filters against what is written, so a batch that is repeated after a failure adds nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        done = spark.read.parquet(out).select("hash").distinct() if exists(spark, out) else None
        build(to_build(batch.dropDuplicates(["hash"]), done)).write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
