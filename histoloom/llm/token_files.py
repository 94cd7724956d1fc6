"""Token counts by a separator scan over flat, unindexed token files.

A token file is one long run of fixed-width token ids; an end-of-document id closes each document.
Files are read in blocks that know nothing of documents. In each block one vectorised search finds
the separators; the tokens before the first and after the last are loose ends. A prefix scan over
the blocks, one row of five numbers a block, carries the loose ends across block boundaries: inside runs of ``RUN`` blocks first, then
over the runs of each file, so that one huge file is scanned by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import fresh, small_batches, written
from .tokens import default_vocabulary, encoder

#: ``<|endoftext|>``: no ordinary text has this id.
END = 50256
BLOCK_TOKENS = 1 << 18
#: Blocks that the first level of the prefix scan joins.
RUN = 4096


def token_files(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = END, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenises ``docs`` into flat files, one a partition, as rows (file, block, ids) of ``block_tokens``
    ids each but the last; beside them, rows (file, first, keys) note which documents went into a
    file, in order, but not where they lie. Documents cross blocks freely.

    A null or empty text is a separator alone; a very long one spans blocks; keys may be null or repeat, rows stay; other columns
    don't matter; an empty table gives no rows. An id beyond ``dtype`` is an error.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    whole = fresh("_whole", [key])
    kind = docs.schema[key].dataType.simpleString()
    limit = np.iinfo(np.dtype(dtype)).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, file = encoder(path), TaskContext.get().partitionId()
        closing = np.array([end], dtype=dtype)
        held, n_held, block, first = [], 0, 0, 0

        def cut(final: bool) -> Iterator[bytes]:
            nonlocal held, n_held
            ids = np.concatenate([*held, closing[:0]])
            whole_blocks = len(ids) // block_tokens * block_tokens
            for i in range(0, whole_blocks, block_tokens):
                yield ids[i : i + block_tokens].tobytes()
            rest = ids[whole_blocks:]
            if final and len(rest):
                yield rest.tobytes()
            held, n_held = [rest], len(rest)

        def rows(parts: list[bytes], keys: pa.Array | None) -> pa.RecordBatch:
            nonlocal block
            n, more = len(parts), int(keys is not None)
            listed = pa.nulls(n, pa.list_(key_type))
            if more:
                listed = pa.concat_arrays([listed, pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)])
            out = pa.RecordBatch.from_arrays(
                [pa.array([file] * (n + more), pa.int32()), pa.array([*range(block, block + n), *[None] * more], pa.int64()), pa.array([*parts, *[None] * more], pa.binary()), pa.array([None] * n + [first] * more, pa.int64()), listed],
                ["file", "block", "ids", "first", "keys"],
            )
            block += n
            return out

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.column(key).type
            parts = []
            for t in batch.column(whole):
                ids = e.encode(t.as_py())
                if len(ids) and ids.max() > limit:
                    raise ValueError(f"token id {ids.max()} does not fit {dtype}")
                held += [ids.astype(dtype), closing]
                n_held += len(ids) + 1
                if n_held >= 4 * block_tokens:
                    parts += cut(False)
            yield rows(parts, batch.column(key))
            first += len(batch)
        if last := list(cut(True)):
            yield rows(last, None)

    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(whole)).mapInArrow(run, f"file int, block long, ids binary, first long, keys array<{kind}>")


def binary_blocks(spark: SparkSession, path: str, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, ids) of raw token files. Spark's binaryFile source hands each file to one task, so a file must stay below 2 GB."""

    def run(batches):
        step = block_tokens * np.dtype(dtype).itemsize
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_py()
                for i in range(0, len(raw), step):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i // step], pa.int64()), pa.array([raw[i : i + step]], pa.binary())], ["file", "block", "ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, ids binary")


def _scanned(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Prefix scan of ``rows`` (docs, closed, tail) in the order of ``at`` within ``by``: ``before``, documents that ended before;
    ``carried``, open tokens at the row's start; ``begun``, whether a separator came before; ``open``, open tokens at its end.
    Counts start with nothing open."""
    in_order = Window.partitionBy(*by).orderBy(at)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("closers", F.sum(F.col("closed").cast("int")).over(so_far))
        .withColumn("before", F.sum("docs").over(so_far) - F.col("docs"))
        .withColumn("open", F.sum("tail").over(Window.partitionBy(*by, "closers").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("carried", F.coalesce(F.lag("open").over(in_order), F.lit(0)))
        .withColumn("begun", F.col("closers") > F.col("closed").cast("int"))
        .drop("closers")
    )


def count_tokens(blocks: DataFrame, end: int = END, dtype: str = "<u2", run: int = RUN) -> DataFrame:
    """(file, ordinal, n_tokens, ended): a row for each document of each file, its separator not
    counted. ``ordinal`` is from 0. Tokens after a file's last separator make a last document with ``ended`` false. Blocks
    may be empty; documents may be longer than any number of blocks; an empty table gives an empty one. Block numbers are distinct in
    a file; null ids count as an empty block; other columns don't matter."""
    kind = blocks.schema["file"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            lead, tail, inner = [], [], []
            for ids in batch.column("ids"):
                tokens = np.frombuffer(ids.as_buffer() if ids.is_valid else b"", dtype=dtype)
                at = np.flatnonzero(tokens == end)
                lead.append(int(at[0]) if len(at) else None)
                tail.append(len(tokens) - 1 - int(at[-1]) if len(at) else len(tokens))
                inner.append((np.diff(at) - 1).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(lead, pa.int64()), pa.array(tail, pa.int64()), pa.array(inner, pa.list_(pa.int64()))], ["file", "block", "lead", "tail", "inner"])

    ends = written(blocks.select("file", "block", "ids").mapInArrow(scan, f"file {kind}, block long, lead long, tail long, inner array<long>"), "ends")
    narrow = ends.select("file", "block", F.floor(F.col("block") / run).cast("long").alias("run"), F.when(F.col("lead").isNull(), 0).otherwise(1 + F.size("inner")).cast("long").alias("docs"), F.col("lead").isNotNull().alias("closed"), "tail")
    inside = _scanned(narrow, ["file", "run"], "block")
    runs = inside.groupBy("file", "run").agg(F.sum("docs").alias("docs"), F.max("closed").alias("closed"), F.max_by("open", "block").alias("tail"))
    outside = written(_scanned(runs, ["file"], "run"), "runs")
    carry = outside.select("file", "run", F.col("before").alias("run_before"), F.col("carried").alias("run_carried"))
    places = inside.join(carry, ["file", "run"]).select("file", "block", (F.col("run_before") + F.col("before")).alias("before"), (F.col("carried") + F.when(F.col("begun"), 0).otherwise(F.col("run_carried"))).alias("carried"))
    done = ends.where("lead IS NOT NULL").join(places, ["file", "block"]).select("file", "before", F.posexplode(F.concat(F.array(F.col("carried") + F.col("lead")), "inner")).alias("i", "n_tokens"))
    done = done.select("file", (F.col("before") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    last = outside.groupBy("file").agg(F.max_by(F.struct("before", "docs", "open"), "run").alias("x")).where("x.open > 0")
    return done.unionByName(last.select("file", (F.col("x.before") + F.col("x.docs")).alias("ordinal"), F.col("x.open").alias("n_tokens"), F.lit(False).alias("ended")))


def op7_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted from flat files of the whole corpus."""
    files = written(token_files(spark.read.parquet(f"{sf_dir}/documents.parquet")), "token-files")
    counts = count_tokens(files.where("block IS NOT NULL"))
    named = files.where("first IS NOT NULL").select("file", "first", F.posexplode("keys").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return named.join(counts, ["file", "ordinal"]).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "file", F.col("ordinal").cast("long").alias("ordinal"))
