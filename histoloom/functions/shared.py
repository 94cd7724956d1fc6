"""Written intermediate tables and global ranks."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set a local session gets a temporary one; a cluster
    gets an error, since its machines don't share their local folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="histoloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers, _before = threading.Lock(), 0, None


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Jobs started within delete their shuffle files as they end; else these stay until the driver happens to collect its garbage."""
    global _writers, _before
    with _lock:
        if not _writers:
            _before = spark.conf.get(_FREED, None)
            spark.conf.set(_FREED, "true")
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                spark.conf.unset(_FREED) if _before is None else spark.conf.set(_FREED, _before)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with a mark by which :func:`written` leaves it bucketed by ``keys``: joins, groups and windows on them, or on them and more, then
    move none of its rows."""
    marked = df.select("*")
    marked._dealt_by = keys
    return marked


def _lies_by(df: DataFrame, keys: Sequence[str], parts: int) -> bool:
    """Whether the rows come dealt by ``keys`` already."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.initialPlan()
    found = plan.outputPartitioning().toString()
    names = [x.partition("#")[0] for x in found.removeprefix("hashpartitioning(").removesuffix(")").split(", ")]
    return names == [*keys, str(parts)]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, deleted when the application ends; after :func:`dealt` in a bucket a shuffle partition."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    keys = getattr(df, "_dealt_by", None)
    with _freed(spark):
        if keys is None:
            df.write.option("compression", "zstd").parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # else joins on the keys and more deal both sides anew
        parts, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"histoloom_{uuid.uuid4().hex}"
        rows = df if _lies_by(df, keys, parts) else df.repartition(parts, *keys)
        rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, *keys).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the plan knows its files and buckets; the catalogue need not
    return table


def dealt_small(df: DataFrame, *keys: str, rows: int = 20_000) -> DataFrame:
    """``df``, written and dealt by ``keys`` to parts of about so many rows: for few bytes that much work hangs on, which would else meet in as many
    tasks as their bytes fill."""
    there = written(df, "few")
    return there.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), there.count() // rows), *keys)


def written_together(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables, each as :func:`written` leaves it. Their jobs run two at a time, so that those of one fill the executors that the
    last tasks of another leave idle, and the shuffle files of two are there at once at most. Meant for the few inputs of one operation."""
    if not tables:
        return {}
    shared_dir(next(iter(tables.values())).sparkSession)  # set once, before the threads ask for it
    with ThreadPoolExecutor(2) as pool:
        return dict(zip(tables, pool.map(written, tables.values(), tables), strict=True))


def with_global_rank(df: DataFrame, order: list[Column], rank: str = "rank", total: str = "total") -> DataFrame:
    """``df`` with each row's place (from 1) in the order over all rows, and the number of rows.

    Rows are range-partitioned, sorted and numbered as they are written; the counts of the partitions before, one row a partition, are
    added. No task sees more than its partition, unlike a window without keys, and rows move once.
    Project to the columns that matter first. The order should be total.
    """
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())  # partition, then 33 bits of place
    ranged = written(numbered, "ranked").withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    every = Window.orderBy("_part")
    counts = counts.withColumn("_before", F.sum("_n").over(every) - F.col("_n")).withColumn(total, F.sum("_n").over(Window.partitionBy()))
    return ranged.join(F.broadcast(counts.drop("_n")), "_part").withColumn(rank, (F.col("_before") + F.col("_at") + 1).cast("long")).drop("_part", "_at", "_before")


def with_running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, str], totals: bool = False) -> DataFrame:
    """``df`` with running sums, within ``keys`` and up to the row in ``order`` (total within the keys), of columns: ``sums`` maps
    each to its sum's name. With ``totals`` also each key's whole sum, under the name and ``_all``.

    Rows are range-partitioned by keys and order and summed within partitions; the sums of a key's partitions before, one row a key and
    partition, are added. So one key, or none, may hold all rows."""
    keys = list(keys)
    ranged = written(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "running")
    before = ranged.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_sum_{n}") for c, n in sums.items()])
    so_far = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    before = before.select(*keys, "_part", *[F.coalesce(F.sum(f"_sum_{n}").over(so_far), F.lit(0)).alias(f"_before_{n}") for n in sums.values()], *([F.sum(f"_sum_{n}").over(whole).alias(f"{n}_all") for n in sums.values()] if totals else []))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumns({n: F.sum(c).over(inside) for c, n in sums.items()})
    joined = summed.join(before.withColumnsRenamed({k: f"_key_{k}" for k in keys}).withColumnRenamed("_part", "_of"), _same(keys))
    out = joined.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums.values()})
    return out.drop("_part", "_of", *[f"_key_{k}" for k in keys], *[f"_before_{n}" for n in sums.values()])


def with_last_seen(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, into: str) -> DataFrame:
    """``df`` with the last ``value`` that is not null, within ``keys`` and up to the row in ``order`` (total within the keys).

    Rows are range-partitioned by keys and order and carried on within partitions; what a key's partitions before end with, one row a key and
    partition, goes on to the next. So one key may hold all rows."""
    keys = list(keys)
    ranged = df.withColumn("_value", value).repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "seen")
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    seen = ranged.withColumn("_seen", F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_at", F.row_number().over(inside))
    ends = seen.groupBy(*keys, "_part").agg(F.max_by("_seen", "_at").alias("_end"))
    so_far = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_of"), F.last("_end", ignorenulls=True).over(so_far).alias("_before"))
    joined = seen.join(ends, _same(keys)).withColumn(into, F.coalesce("_seen", "_before"))
    return joined.drop("_value", "_part", "_of", "_seen", "_at", "_before", *[f"_key_{k}" for k in keys])


def _same(keys: Sequence[str]) -> Column:
    out = F.col("_part") == F.col("_of")
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return out


def md5_order(seed: int, *parts: str | Column) -> list[Column]:
    """A shuffled but repeatable order: the md5 of the seed and the id, then the id."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return [F.md5(F.concat(F.lit(str(seed)), *columns).cast("binary")), *columns]
