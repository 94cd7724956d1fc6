"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set a local session gets a temporary one; a cluster
    gets an error, since its machines don't share their local folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="histoloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path not used before; its files go when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe when executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    if stack := _OPEN.get():
        stack[-1].append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by :func:`written` that no pending result reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Tables written in the blocks of :func:`scratch` that are open, by thread or task of the driver.
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())


@contextmanager
def scratch() -> Iterator[None]:
    """A block whose written tables go at its end, but for those given to :func:`kept`."""
    own: list[DataFrame] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for df in own:
            dropped(df)


def kept(df: DataFrame) -> DataFrame:
    """``df``, a written table, outlives the block; an outer one, if any, takes it over."""
    stack = _OPEN.get()
    stack[-1][:] = [x for x in stack[-1] if x is not df]
    if len(stack) > 1:
        stack[-2].append(df)
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows and bytes of a batch that goes to a Python worker, and rows that the Parquet reader decodes at once: texts are long, and a
#: task holds a batch several times over.
BATCH_ROWS, BATCH_BYTES, READ_ROWS = 2500, 1 << 20, 512


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes (or one longer row), and its Parquet
    batches to ``READ_ROWS`` rows. Results are lazy, so the limits stay in the session; lower ones of the caller's are left alone."""
    for name, most in (("execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("parquet.columnarReaderBatchSize", READ_ROWS)):
        now = int(str(spark.conf.get(f"spark.sql.{name}")).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.{name}", str(most))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def schema_of(df: DataFrame, *more: str) -> str:
    """The DDL of a frame's columns and some more."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + list(more))
