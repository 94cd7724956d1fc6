"""Suffix-array dedup with sparse suffix arrays.

Suffixes are kept at minimiser positions only: of every run of ``REACH`` neighbouring ``GRAM``-word grams, the
position with the least hash. The choice depends on the run's words alone, so equal passages keep
suffixes at equal places. Every window of ``PASSAGE`` = 50 words has its minimiser among its first 27 positions, so at least the suffix's
24 leading words lie inside the window.

1. The suffixes are sorted by their 24 leading words, taken as one symbol (a 64-bit hash). Those that agree with a neighbour go on.
2. These are sorted in suffix order: by the leading symbol and then word by word, with up to 26 words to the right and 26 to the
   left of it. Neighbours are compared: the words that they share to the right give the length of their match on that side. The
   same is done to the left, in the order of the words before. A window that begins ``l`` words before a suffix occurs at two of
   them if all neighbours between them in suffix order share its ``50 - l`` words to the right, and all between them in the
   order to the left its ``l`` words there.
3. Of the places of a window the first, by (document, position), stays; the spans of the others come from the lengths, a row for
   each suffix and run of windows rather than for each window.

A leading symbol of many suffixes is dealt out over several tasks; each settles what it has, and only the first place of each window in
it meets those of the other tasks, in one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .idfilter import bitmap, bits_at, bits_for
from .kernels import mix, windows, words
from .storage import fresh, kept, schema_of, scratch, shuffle_partitions, small_batches, written

PASSAGE = 50
GRAM = 8
REACH = 27
LEAD = PASSAGE - REACH + 1
#: Words compared on each side of the leading ones.
SIDE = PASSAGE - LEAD
#: Suffixes that a task compares at once.
CHUNK = 1 << 15
#: A leading symbol with more suffixes, and more than one in ``SHARE`` of all, is dealt out; there are at most ``SHARE`` of them.
HEAVY, SHARE = 2000, 100_000
_LAST = (1 << 63) - 1
_SPANS = "array<struct<start:long,end:long>>"


def _identity(docs: DataFrame, key: str, text: str) -> list[Column]:
    """A row is known by its key (nulls last) and a 64-bit hash of its text, so rows that share a key but not the
    text stay apart, and repeated rows count as one document."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tid")]


def _minimisers(hashes: np.ndarray) -> np.ndarray:
    """For each window of ``PASSAGE`` words of a document, the position of its suffix; they never go back."""
    grams = windows(hashes, GRAM)
    n = len(hashes) - PASSAGE + 1
    out = np.empty(n, dtype=np.int64)
    for a in range(0, n, 1 << 15):
        b = min(n, a + (1 << 15))
        out[a:b] = np.lib.stride_tricks.sliding_window_view(grams[a : b + REACH - 1], REACH).argmin(axis=1) + np.arange(a, b)
    return out


def _long_documents(batch: pa.RecordBatch, seen: set) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of the texts that hold a passage at all and that the task has not met before."""
    doc, tid = batch.column("doc").to_numpy(), batch.column("tid").to_numpy()
    for w in words(batch.column("whole"), "space"):
        for d in np.flatnonzero(np.diff(w.bounds) >= PASSAGE).tolist():
            own = int(doc[w.first + d]), int(tid[w.first + d])
            if own not in seen:
                seen.add(own)
                yield w.first + d, w.hashes[w.bounds[d] : w.bounds[d + 1]]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for batch in batches:
        lead, at, rows = [], [], []
        for row, h in _long_documents(batch, seen):
            at.append(np.unique(_minimisers(h)))
            lead.append(windows(h, LEAD)[at[-1]])
            rows.append(np.full(len(at[-1]), row))
        if rows:
            own = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lead).view(np.int64)), batch.column("doc").take(own), batch.column("tid").take(own), pa.array(np.concatenate(at).astype(np.int32))], ["lead", "doc", "tid", "at"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted part: the suffixes that agree with a neighbour, and the part's first and last, whose neighbours are elsewhere."""
    held, agrees = None, True
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        lead = batch.column("lead").to_numpy()
        same = lead[1:] == lead[:-1]
        going = np.concatenate(([agrees], same)) | np.concatenate((same, [False]))
        held, agrees = batch.slice(len(batch) - 1), bool(going[-1])
        yield batch.take(pa.array(np.flatnonzero(going[:-1])))
    if held is not None:
        yield held


def _fixed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    wide = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * wide).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate suffixes with the words around them, 32 bits each, and the windows that are theirs: those that begin ``low`` to
    ``high`` words before. A task emits a few thousand rows at a time."""
    seen: set = set()
    right, left = np.arange(LEAD, LEAD + SIDE), -np.arange(1, SIDE + 1)
    for batch in batches:
        places = batch.column("places")
        for row, h in _long_documents(batch, seen):
            own = places[row].values
            order = np.argsort(own.field("at").to_numpy())
            at, salt = (own.field(c).to_numpy()[order] for c in ("at", "salt"))
            of, lead = _minimisers(h), windows(h, LEAD)
            code = np.concatenate((np.zeros(SIDE, np.uint32), np.maximum(h >> np.uint64(32), np.uint64(1)).astype(np.uint32), np.zeros(PASSAGE, np.uint32)))
            for i in range(0, len(at), 4096):
                a = at[i : i + 4096].astype(np.int64)
                first, last = np.searchsorted(of, a), np.searchsorted(of, a, side="right") - 1
                n = len(a)
                around = [_fixed(code[a[:, None] + SIDE + side]) for side in (right, left)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead[a].view(np.int64)), pa.array(salt[i : i + 4096]), *around, *(pa.array([batch.column(c)[row].as_py()] * n, pa.int64()) for c in ("doc", "tid")), pa.array(a.astype(np.int32)), pa.array((a - last).astype(np.int8)), pa.array((a - first).astype(np.int8))],
                    ["lead", "salt", "right", "left", "doc", "tid", "at", "low", "high"],
                )


def _shared(rows: np.ndarray) -> np.ndarray:
    """How many leading words each row of a matrix shares with the one before."""
    same = rows[1:] == rows[:-1]
    return np.concatenate(([0], np.where(same.all(axis=1), rows.shape[1], (~same).argmax(axis=1)))) if len(rows) else np.zeros(0, int)


def earlier_places(group: np.ndarray, right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order, a row for each and a column for each distance ``l`` from 0 to ``SIDE``: the suffix that holds the
    first place of the window that begins ``l`` words before it (itself, if it is the first), or -1 where that window isn't its own.

    ``group``: equal for equal leading symbols; ``rank``: order of the places, equal for equal ones."""
    n = len(group)
    new_group = np.concatenate(([True], group[1:] != group[:-1]))
    # Matches of neighbours: words shared to the right in suffix order, and to the left in the order of the words before.
    to_right = np.where(new_group, -1, _shared(right))
    other = np.lexsort((np.ascontiguousarray(left).view(f"S{left.shape[1] * left.itemsize}").ravel(), group))
    to_left = np.where(np.concatenate(([True], group[other][1:] != group[other][:-1])), -1, _shared(left[other]))
    out = np.full((n, SIDE + 1), -1, dtype=np.int64)
    for distance in range(SIDE + 1):
        block = np.cumsum(to_right < SIDE - distance)
        run = np.empty(n, dtype=np.int64)
        run[other] = np.cumsum(to_left < distance)
        own = np.flatnonzero((low <= distance) & (distance <= high))
        order = own[np.lexsort((rank[own], run[own], block[own]))]
        if len(order):
            begins = np.concatenate(([True], (block[order][1:] != block[order][:-1]) | (run[order][1:] != run[order][:-1])))
            out[order, distance] = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
    return out


def _matched(chunk: int):
    """Of context rows in suffix order: (window, doc, tid, start, end, source). Rows without ``window`` are spans of repeated
    windows; those with one (a hash of its words) are first places here that may have an earlier one in another task."""

    def settle(table: pa.Table, cut: bool) -> pa.RecordBatch:
        """``cut``: the rows are of one symbol and go on in the next chunk or came from the one before."""
        lead, salt, doc, tid, at, low, high = (table.column(c).to_numpy() for c in ("lead", "salt", "doc", "tid", "at", "low", "high"))
        right, left = (np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column(c)]) for c in ("right", "left"))
        order = np.lexsort((at, tid, doc))
        placed = np.stack((doc, tid, at.astype(np.int64)))
        rank = np.empty(len(at), dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate(([False], (placed[:, order][:, 1:] != placed[:, order][:, :-1]).any(axis=0))))
        group = np.cumsum(np.concatenate(([True], lead[1:] != lead[:-1])))
        head = earlier_places(group, right, left, low, high, rank)
        later = (head >= 0) & (rank[head] != rank[:, None])
        # Runs of neighbouring windows with one source become spans.
        code = np.pad(np.where(later, doc[head], -_LAST), ((0, 0), (1, 1)), constant_values=-_LAST)
        row, column = np.nonzero((code[:, 1:] != code[:, :-1]) & (code[:, 1:] != -_LAST))
        row_end, end = np.nonzero((code[:, 1:] != code[:, :-1]) & (code[:, :-1] != -_LAST))
        spans = [np.zeros(len(row), np.int64), doc[row], tid[row], at[row] - end + 1, at[row] - column + PASSAGE, code[row, column + 1]]
        waiting = (head == np.arange(len(at))[:, None]) & ((salt > 0) | cut)[:, None]
        row, distance = np.nonzero(waiting)
        begin = at[row] - distance
        # The words of a window: its leading symbol, and those to the left and right that belong to it.
        h = mix(lead[row].view(np.uint64) + distance.astype(np.uint64))
        for i in range(SIDE):
            h = np.where(i < distance, mix(h ^ left[row, i]), mix(h + right[row, np.minimum(i - distance, SIDE - 1)]))
        first = [h.view(np.int64), doc[row], tid[row], begin, begin + PASSAGE, np.zeros(len(row), np.int64)]
        known = np.concatenate((np.ones(len(spans[0]), bool), np.zeros(len(h), bool)))
        columns = [np.concatenate((a, b)).astype(np.int64) for a, b in zip(spans, first, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], mask=known), *map(pa.array, columns[1:])], ["window", "doc", "tid", "start", "end", "source"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, cut = [], 0, False
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            n += len(batch)
            if n < chunk:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in ("lead", "salt")])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if not len(ends):
                yield settle(table, True)
                held, n, cut = [], 0, True
                last = keys[:, -1]
                continue
            if cut and (keys[:, 0] == last).all():  # the rest of a symbol that was cut
                yield settle(table.slice(0, ends[0]), True)
            else:
                ends = np.concatenate(([0], ends))
            if ends[-1] > ends[0]:
                yield settle(table.slice(ends[0], ends[-1] - ends[0]), False)
            held, cut = table.slice(ends[-1]).combine_chunks().to_batches(), False
            n = sum(map(len, held))
        if held:
            table = pa.Table.from_batches(held)
            if cut:
                keys = np.stack([table.column(c).to_numpy() for c in ("lead", "salt")])
                other = np.flatnonzero((keys != last[:, None]).any(axis=0))
                end = int(other[0]) if len(other) else len(table)
                if end:
                    yield settle(table.slice(0, end), True)
                table = table.slice(end)
            if len(table):
                yield settle(table, False)

    return run


def _maybe_in(ids: DataFrame) -> Column | None:
    """A test on the columns of ``ids`` (by name), false only for rows that it doesn't have; none where its filter would pass its bound."""
    bits = bits_for(ids.count())
    if bits is None:
        return None
    shared = ids.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64(*ids.columns)), bits))

    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        return pa.array(bits_at(shared.value, hashes.to_numpy() % bits))

    return test(F.xxhash64(*ids.columns))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of doc, tid and start to a row for each document: its spans united, and their sources."""
    key, spans, sources = None, [], set()

    def row() -> pa.RecordBatch:
        found = pa.array([[{"start": a, "end": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), found, pa.array([sorted(sources)], pa.list_(pa.int64()))], ["doc", "tid", "spans", "sources"])

    for batch in batches:
        for doc, tid, start, end, source in zip(*(batch.column(c).to_pylist() for c in ("doc", "tid", "start", "end", "source")), strict=True):
            if (doc, tid) != key:
                if key is not None:
                    yield row()
                key, spans, sources = (doc, tid), [], set()
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([start, end])
            sources.add(source)
    if key is not None:
        yield row()


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = HEAVY, chunk: int = CHUNK) -> DataFrame:
    """(doc, tid, spans, sources), a written table: for each document with words that an earlier document or passage has in the
    same window of ``PASSAGE`` words: the merged word ranges, and ids of documents that hold earlier
    occurrences (null keys as the greatest long). ``doc`` is the key, ``tid`` tells texts of one key apart.

    Results don't depend on ``heavy`` and ``chunk``. Words beside the leading ones are compared by 32 bits each."""
    small_batches(docs.sparkSession)
    source = docs.select(*_identity(docs, key, text), F.coalesce(F.col(text), F.lit("")).alias("whole"))
    place = ["lead", "doc", "tid", "at"]
    with scratch():
        suffixes = written(source.mapInArrow(_suffixes, "lead long, doc long, tid long, at int"), "suffixes")
        array = suffixes.repartitionByRange(shuffle_partitions(docs.sparkSession), *place).sortWithinPartitions(*place)
        candidates = written(array.mapInArrow(_neighbours, "lead long, doc long, tid long, at int"), "candidates")
        counts = candidates.groupBy("lead").agg(F.count("*").alias("n"))
        most = max(heavy, candidates.count() // SHARE)
        dealt = candidates.join(F.broadcast(counts.where(F.col("n") > most)), "lead", "left")
        salt = F.when(F.col("n").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("doc", "tid", "at"), F.ceil(F.col("n") / most)))
        found = written(dealt.groupBy("doc", "tid").agg(F.collect_set(F.struct("at", salt.cast("int").alias("salt"))).alias("places")), "places")
        test = _maybe_in(found.select("doc", "tid"))
        likely = source if test is None else source.where(test)
        around = likely.join(found, ["doc", "tid"]).mapInArrow(_contexts, "lead long, salt int, right binary, left binary, doc long, tid long, at int, low byte, high byte")
        ordered = around.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "right", "left", "doc", "tid", "at")
        matched = written(ordered.mapInArrow(_matched(chunk), "window long, doc long, tid long, start long, end long, source long"), "matched")
        spans, waiting = matched.where("window IS NULL"), matched.where("window IS NOT NULL")
        first = waiting.groupBy("window").agg(F.min(F.struct("doc", "tid", "start")).alias("first"))
        later = waiting.join(first, "window").where(F.struct("doc", "tid", "start") != F.col("first")).withColumn("source", F.col("first.doc"))
        spans = spans.unionByName(later.select(*spans.columns)).select("doc", "tid", "start", "end", "source")
        merged = spans.repartition("doc", "tid").sortWithinPartitions("doc", "tid", "start").mapInArrow(_merge, f"doc long, tid long, spans {_SPANS}, sources array<long>")
        return kept(written(merged, "spans"))


def _cut(columns: list[str], text: str, new: list[str]):
    """The rows with ``text`` less the words of its spans (column ``new[0]``), up to the next kept word; and n_words, n_repeated."""

    def run(batches):
        for batch in batches:
            spans, counts, gone, texts = batch.column(new[0]), [], [], []
            for w in words(batch.column(text).fill_null(""), "space"):
                for d in range(w.n):
                    at, stop = int(w.bounds[d]), int(w.bounds[d + 1])
                    counts.append(stop - at)
                    own = spans[w.first + d].as_py()
                    if not own:
                        gone.append(0)
                        texts.append(batch.column(text)[w.first + d].as_py())
                        continue
                    gone.append(sum(s["end"] - s["start"] for s in own))
                    parts, lo, hi = [], int(w.offsets[d]), int(w.offsets[d + 1])
                    for s in own:
                        parts.append(w.data[lo : w.starts[at + s["start"]]].tobytes())
                        lo = int(w.starts[at + s["end"]]) if at + s["end"] < stop else hi
                    texts.append(b"".join([*parts, w.data[lo:hi].tobytes()]).decode())
            out = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], [*columns, *new[1:]])

    return run


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with the words of repeated passages cut out of ``text``; with ``report`` also n_words and
    n_repeated (before and cut), spans and sources.

    Order is by key, null keys last. Repeated rows (same key and text) count as one document and are cut alike; rows that share
    a key with other texts are separate documents. A null or empty text, or one of less than ``PASSAGE`` words,
    stays as it is; of a very long one every window counts. Repeats inside a document count: of a loop its first turn stays. An
    empty table gives an empty one. The key must be an integer; helper columns give way to columns of ``docs``.
    """
    columns = [c for c in docs.columns if not report or c not in ("n_words", "n_repeated", "spans", "sources")]
    taken = [*docs.columns, "n_words", "n_repeated", "spans", "sources"]
    doc, tid, of, by, n_w, n_r = (fresh(x, taken) for x in ("_doc", "_tid", "_of", "_by", "_nw", "_nr"))
    spans = repeated_spans(docs, key, text).select(F.col("doc").alias(doc), F.col("tid").alias(tid), F.col("spans").alias(of), F.col("sources").alias(by))
    marked = docs.select(*columns, *(c.alias(n) for c, n in zip(_identity(docs, key, text), (doc, tid), strict=True)))
    test = _maybe_in(spans.select(doc, tid))
    if test is not None:
        marked = marked.withColumn(n_w, test)
    hit = (marked if test is None else marked.where(n_w).drop(n_w)).join(spans, [doc, tid], "left").select(*columns, of, by)
    if not report:
        cut = hit.drop(by).mapInArrow(_cut(columns, text, [of, n_w, n_r]), schema_of(docs.select(*columns), f"{n_w} long", f"{n_r} long")).select(*columns)
        return cut if test is None else cut.unionByName(marked.where(~F.col(n_w)).select(*columns))
    none = spans.schema
    if test is not None:
        hit = hit.unionByName(marked.where(~F.col(n_w)).select(*columns, F.lit(None).cast(none[of].dataType).alias(of), F.lit(None).cast(none[by].dataType).alias(by)))
    every = hit.select(*columns, F.coalesce(of, F.array().cast(none[of].dataType)).alias("spans"), F.coalesce(by, F.array().cast(none[by].dataType)).alias("sources"))
    kept_ = [*columns, "spans", "sources"]
    return every.mapInArrow(_cut(kept_, text, ["spans", "n_words", "n_repeated"]), schema_of(every.select(*kept_), "n_words long", "n_repeated long"))


def op4_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs, report=True).select("doc_id", "n_words", "n_repeated", "spans", "sources", "text")
