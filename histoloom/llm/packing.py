"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens. Each partition packs its pieces by best-fit
decreasing and computes lower bounds on its number of bins from dual feasible functions. A
partition that meets its bound is certified and final but for its emptiest bin. The others keep their full
bins, exchange the documents of all others among each other, and pack again, until all are certified or a round saves no
bin. Where the partitions' bounds together exceed the bound of all lengths (their contents
differ too much to certify each other), certified ones exchange the documents of their open bins too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fresh, small_batches, written
from .tokens import default_vocabulary, encoder

CAPACITY = 1024
#: Pieces that one task packs at once.
PART_PIECES = 100_000
#: Bits of a sequence id for the bin, the task and the task's run of pieces.
_BIN_BITS, _TASK_BITS, _RUN_BITS = 20, 22, 20


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int | None = 2, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """(key, piece, start, length, ids_crc32, part) of each document: its ids and then ``end``; a
    longer one is cut into pieces of ``capacity``, the first of which takes what is left over.

    A null text is empty; without ``end`` an empty text has no piece. ``part`` numbers the runs of
    at most ``part_pieces`` pieces that a partition yields, so no key can fill one. Repeated rows and null keys stay; other columns
    don't matter; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    whole = fresh("_whole", [key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, made, task = encoder(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            rows, piece, start, length, crc, part = [], [], [], [], [], []
            for i, t in enumerate(batch.column(whole)):
                ids = e.encode(t.as_py())
                if end is not None:
                    ids = np.append(ids, np.uint32(end))
                cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)] if len(ids) else [0]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(i)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].astype("<u4").tobytes()))
                    if made // part_pieces >> _RUN_BITS or task >> _TASK_BITS:
                        raise OverflowError("more partitions, or pieces in one, than part numbers can tell apart")
                    part.append(task + (made // part_pieces << _TASK_BITS))
                    made += 1
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, part))], [key, "piece", "start", "length", "ids_crc32", "part"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(whole)).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, part long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the free space of each bin. Open bins stand by free space; a bit
    set of the spaces that occur finds the least that fits."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    free: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = spaces >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            own = open_bins[space]
            b = own.pop()
            if not own:
                spaces ^= 1 << space
        else:
            b, space = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - space
        free[b] = left = space - n
        if left:
            open_bins[left].append(b)
            spaces |= 1 << left
    return bins, offsets, np.array(free, dtype=np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """For ``count[n]`` items of each length n the best bound of two families of dual feasible functions: items above
    ``capacity - k`` count whole and items below ``k`` not at all, for each k; and lengths rounded down to multiples of 1/p."""
    sizes = np.arange(capacity + 1)
    above = np.concatenate((np.cumsum(count[::-1])[::-1], [0]))  # items of at least so many tokens
    tokens = np.concatenate((np.cumsum((count * sizes)[::-1])[::-1], [0]))
    k = np.arange(capacity // 2 + 1)
    best = int((above[capacity - k + 1] + -(-(tokens[k] - tokens[capacity - k + 1]) // capacity)).max())
    for p in range(1, 51):
        scaled = np.where(sizes * (p + 1) % capacity == 0, sizes * p, (p + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (p * capacity)))
    return best


def _pack_round(pieces: DataFrame, capacity: int) -> DataFrame:
    """Packs each part. ``pooled`` marks the pieces that go on by the part's own bound, ``open`` those in bins with room."""

    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        part = table.column("part")[0].as_py()
        bound = lower_bound(lengths, capacity)
        if len(free) >> _BIN_BITS:
            raise OverflowError(f"{len(free)} sequences in a part")
        going = free > 0 if len(free) > bound else np.arange(len(free)) == (int(free.argmax()) if free.max(initial=0) else -1)
        n = len(bins)
        for name, values in (("sequence_id", (part << _BIN_BITS) + bins), ("offset", offsets), ("pooled", going[bins]), ("open", free[bins] > 0), ("part_bins", np.full(n, len(free))), ("part_bound", np.full(n, bound))):
            table = table.append_column(name, pa.array(values))
        return table

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.groupBy("part").applyInArrow(pack, f"{schema}, sequence_id long, offset long, pooled boolean, open boolean, part_bins long, part_bound long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """``pieces`` (length from 1 to ``capacity``, part) with sequence_id and offset, and the certificate of the part in which the
    piece was placed: part, part_bins (its sequences), part_bound (the lower bound on them) and certified (whether they are equal).

    Every piece gets a place of its own; a sequence holds at most ``capacity`` tokens, gapless from offset 0.
    An empty table gives an empty one. Parts hold at most about ``part_pieces`` pieces, so tasks stay
    bounded; the driver sees counts only. Rounds go on until all parts are certified, none can exchange, or a round saves no sequence.
    """
    columns = [c for c in pieces.columns if c not in ("part", "part_bins", "part_bound", "certified")]
    done, todo, going, r = [], pieces.select(*columns, "part"), None, 0
    while True:
        packed = written(_pack_round(todo, capacity), f"packed-{r}")
        if r:
            old = before.where(going).agg(F.countDistinct("sequence_id")).first()[0]
            if packed.agg(F.countDistinct("sequence_id")).first()[0] >= old:
                done.append(before.where(going))
                break
        # Lengths are at most ``capacity``, so the histogram has as many rows.
        counts = np.zeros(capacity + 1, dtype=np.int64)
        for x in packed.groupBy("length").agg(F.count("*").alias("n")).collect():
            counts[x.length] = x.n
        parts, bounds, top = packed.groupBy("part").agg(F.max("part_bound").alias("b")).agg(F.count("*"), F.sum("b"), F.max("part")).first()
        apart = parts > 1 and bounds > bound_of_counts(counts, capacity) + parts
        going = F.col("open") if apart else F.col("pooled")
        pooled, parts = packed.where(going).agg(F.count("*"), F.countDistinct("part")).first()
        if not pooled or parts == 1:
            done.append(packed)
            break
        done.append(packed.where(~going))
        before, n, r = packed, -(-pooled // part_pieces), r + 1
        part = F.lit(top + 1) + F.pmod(F.xxhash64("sequence_id", "offset", F.lit(r)), F.lit(n))
        todo = packed.where(going).select(*columns, part.cast("long").alias("part"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*columns, "sequence_id", "offset", "part", "part_bins", "part_bound", (F.col("part_bins") == F.col("part_bound")).alias("certified"))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int | None = 2, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of :func:`token_pieces` in sequences, as :func:`pack` places them.

    Null and empty texts are the end id alone; very long ones become several pieces; repeated rows, ties of length and null keys all
    keep their rows; other columns of ``docs`` don't matter; an empty table gives an empty one.
    """
    return pack(written(token_pieces(docs, key, text, vocabulary, end, capacity), "pieces"), capacity)


def op8_bound_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
