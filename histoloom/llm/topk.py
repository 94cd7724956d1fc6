"""Exact top-k search by inner product: distributed histogram selection.

Queries go out in chunks of bounded bytes. In each round every row is scored against a chunk and tasks count the scores by query and
bin; the counts' sums by query tell the bin that holds the kth value, which the next round cuts into bins anew, until it is one
score wide. Then rows of at least that score are kept; ties go to the smaller id. A task sends on only the bins from its
highest down to the one that completes k: its own kth score bounds the global one from below.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import fresh, new_path, small_batches, written

#: Bytes of the queries that are scored in one pass; tasks and the driver hold a chunk and k rows of each of its queries.
CHUNK_BYTES = 4 << 20
#: Bins of a histogram, and queries whose histograms a task holds at once.
BINS, QUERIES = 4096, 256
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def integers(vectors: pa.Array, scale: float, dims: int) -> np.ndarray:
    """floor(scale * x) of list entries, as float64; rows are cut or filled with zeros to ``dims``."""
    values, lengths = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale), vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    row, at = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row[at < dims], at[at < dims]] = values[at < dims]
    return out


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of the rows of ``a`` and ``b``: by float64 where all sums are ``exact`` in it, else by Python's integers, cut to
    the range of a long."""
    if exact:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, _LEAST, _MOST)


def _top_bins(query: np.ndarray, at: np.ndarray, count: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of counts by (query, bin), without bins below the one in which a query's sum from the top reaches its need."""
    key, place = np.unique(query * BINS + (BINS - 1 - at), return_inverse=True)  # highest bin first
    sums = np.bincount(place, weights=count, minlength=len(key)).astype(np.int64)
    query, at = key // BINS, BINS - 1 - key % BINS
    above = np.cumsum(sums) - sums
    first = np.searchsorted(query, query)
    keep = above - above[first] < need[query] if len(key) else np.zeros(0, dtype=bool)
    return query[keep], at[keep], sums[keep]


class _Chunk:
    """A chunk of queries and what the rounds know of each: its kth score is in [low, high), ``above`` scores are at least ``high``."""

    def __init__(self, asked: pa.Table, scale: float, dims: int, most: int, k: int):
        self.row = asked.column("row").to_numpy()
        self.id = asked.column("id").combine_chunks()
        self.vectors = integers(asked.column("v").combine_chunks(), scale, dims)
        self.scale, self.dims, self.k = scale, dims, k
        sizes = [sum(abs(int(x)) for x in v) for v in self.vectors.tolist()]
        reach = [min(max(1, s * most), _MOST + 1) for s in sizes]
        self.exact = max(reach, default=0) < 1 << 53
        kind = np.int64 if self.exact else object
        self.low, self.high = np.array([-x for x in reach], dtype=kind), np.array([x + 1 for x in reach], dtype=kind)
        self.above = np.zeros(len(reach), dtype=np.int64)

    def width(self) -> np.ndarray:
        return -((self.low - self.high) // BINS)

    def open(self) -> bool:
        return bool((self.high - self.low > 1).any())

    def located(self, found: list[Any]) -> None:
        """Takes (query, bin, above) of the bins that hold the kth scores; a query without one has fewer candidates: all are wanted."""
        width = self.width()
        seen = np.zeros(len(self.low), dtype=bool)
        for q, at, above in found:
            seen[q] = True
            self.low[q] += at * width[q]
            self.high[q] = min(self.high[q], self.low[q] + width[q])
            self.above[q] += above
        self.high[~seen] = self.low[~seen] + 1

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first query, scores, whether a row is another than the query's own) by block of queries."""
        rows, vectors = batch.column("row").to_numpy(), integers(batch.column("v"), self.scale, self.dims)
        for a in range(0, len(self.row), QUERIES):
            yield a, products(self.vectors[a : a + QUERIES], vectors, self.exact), self.row[a : a + QUERIES, None] != rows[None, :]


def _histograms(rows: DataFrame, sent: Any) -> DataFrame:
    """(query, at, n): counts of scores by bin of each query's interval."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: _Chunk = sent.value
        width, need = chunk.width(), chunk.k - chunk.above
        held = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        for batch in batches:
            more = [held]
            for a, scores, other in chunk.scores(batch):
                block = slice(a, a + QUERIES)
                inside = ((scores >= chunk.low[block, None]) & (scores < chunk.high[block, None])).astype(bool) & other
                query, _ = np.nonzero(inside)
                at = ((scores - chunk.low[block, None]) // width[block, None])[inside].astype(np.int64)
                flat = np.bincount(query * BINS + at, minlength=0)
                some = np.flatnonzero(flat)
                more.append((a + some // BINS, some % BINS, flat[some]))
            held = _top_bins(*(np.concatenate(x) for x in zip(*more, strict=True)), need)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held], ["query", "at", "n"])

    return rows.select("row", "v").mapInArrow(run, "query long, at long, n long")


def _best(rows: DataFrame, sent: Any, id_type: str) -> DataFrame:
    """(query, query_id, row, id, score) of rows that score at least a query's kth value; of those that equal it a task keeps k at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: _Chunk = sent.value
        held: pa.Table | None = None
        for batch in batches:
            for a, scores, other in chunk.scores(batch):
                query, at = np.nonzero((scores >= chunk.low[a : a + QUERIES, None]).astype(bool) & other)
                score = scores[query, at].astype(np.int64)
                found = pa.table([pa.array(query + a), batch.column("row").take(pa.array(at)), batch.column("id").take(pa.array(at)), pa.array(score)], ["query", "row", "id", "score"])
                held = _first(found if held is None else pa.concat_tables([held, found]), chunk.k)
        if held is not None:
            yield from held.add_column(1, "query_id", chunk.id.take(held.column("query").combine_chunks())).to_batches()

    return rows.select("row", "id", "v").mapInArrow(run, f"query long, query_id {id_type}, row long, id {id_type}, score long")


def _first(found: pa.Table, k: int) -> pa.Table:
    """The first k of each query, by falling score and rising id, null ids last."""
    found = found.sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending"), ("row", "ascending")])
    query = found.column("query").to_numpy()
    return found.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < k))


def top_k(vectors: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(query_id, rank, key, score): for each row where ``queries`` holds, the ``k`` other rows of the highest scores, or all if fewer.

    The score is the inner product of floor(scale * x) over the components, exact; one beyond 64 bits is given, and ranked, as the
    nearest long. Ties go to the smaller id, null ids last. Vectors that are null or hold a null or a non-finite component, also after scaling, take no
    part; where lengths differ, missing components count 0. Every row counts by itself: rows of repeated ids are queries and candidates
    each, and only its own row is left out of a query's candidates. An empty table gives an empty one; other columns don't matter; the
    new names give way to the key's.

    Work is rows x queries, in one pass a round and chunk. What moves are at most k bins or rows of each query and task; the
    driver gets a chunk's queries and one row of each a round.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    id_type = vectors.schema[key].dataType.simpleString()
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < float("inf"), F.lit(False)))
    taking = vectors.where(F.col(vector).isNotNull() & finite)
    rows = written(taking.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")), "vectors")
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    asked, dims, most = rows.agg(F.count_if("asks"), F.max(F.when(F.col("asks"), F.size("v"))), largest).first()
    names = [fresh(c, [key]) for c in ("query_id", "rank", "score")]
    result, path = f"{names[0]} {id_type}, {names[1]} int, `{key}` {id_type}, {names[2]} long", new_path(spark, "topk")
    if not asked:
        return spark.createDataFrame([], result)
    chunks = max(1, -(-asked * 8 * max(1, dims) // chunk_bytes))
    of = F.pmod(F.xxhash64("row"), F.lit(chunks))
    highest = Window.partitionBy("query").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    for c in range(chunks):
        chunk = _Chunk(rows.where(F.col("asks") & (of == c)).select("row", "id", "v").toArrow(), scale, dims, int(scale * (most or 0)) + 1, k)
        if not len(chunk.row):
            continue
        while chunk.open():
            sent = spark.sparkContext.broadcast(chunk)
            counts = _histograms(rows, sent).groupBy("query", "at").agg(F.sum("n").alias("n")).withColumn("so_far", F.sum("n").over(highest))
            need = spark.createDataFrame([(i, int(x)) for i, x in enumerate(k - chunk.above)], "query long, need long")
            kth = counts.join(F.broadcast(need), "query").where("so_far >= need").groupBy("query").agg(F.max_by(F.struct("at", (F.col("so_far") - F.col("n")).alias("above")), "at").alias("x"))
            chunk.located([(r.query, r.x.at, r.x.above) for r in kth.collect()])
            sent.unpersist()
        best = _best(rows, spark.sparkContext.broadcast(chunk), id_type)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
        ranked = best.withColumn("rank", place).where(F.col("rank") <= k)
        ranked.select(F.col("query_id").alias(names[0]), F.col("rank").alias(names[1]), F.col("id").alias(key), F.col("score").alias(names[2])).write.mode("append").parquet(path)
    return spark.read.schema(result).parquet(path)


def op12_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
