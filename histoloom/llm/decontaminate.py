"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton holds every run of words of every item. A document's words stream through it; the
length of the longest match that ends at each word tells which windows of item words occur there.
Words covered by such windows are hit: they can be reported as spans or removed.

The items are broadcast in blocks of at most ``BLOCK_BYTES`` of text, whatever the benchmark's size:
one pass over the documents for each block, always on the original text. Where there are several, the
rows get ids in a written table first; the blocks' spans are united by that id, and cut once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import words
from .storage import fresh, schema_of, small_batches, written

WINDOW = 10
#: Bytes of benchmark text whose automaton a task builds and holds at once.
BLOCK_BYTES = 4 << 20
#: A document with a larger share of hit words is dropped whole by :func:`decontaminate`.
DROP_SHARE = 0.8


class Automaton:
    """Generalised suffix automaton over integer words, with the items of each window at its states."""

    def __init__(self, items: list[list[int]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)
        self.window_items: dict[int, set[int]] = {}
        self.short_items: dict[int, dict[int, set[int]]] = {}
        for i, item in enumerate(items):
            for state, matched in self.matches(item):
                if matched >= window:
                    self.window_items.setdefault(self._suffix(state, window), set()).add(i)
            if 0 < len(item) < window:
                self.short_items.setdefault(self._suffix(state, len(item)), {}).setdefault(len(item), set()).add(i)
        self.short_lengths = sorted({len(x) for x in items if 0 < len(x) < window})

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        have = nxt[last].get(word)
        if have is not None and length[have] == length[last] + 1:
            return have
        if have is not None:
            return self._split(last, word, have)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at >= 0:
            target = nxt[at][word]
            link[new] = target if length[target] == length[at] + 1 else self._split(at, word, target)
        return new

    def _split(self, at: int, word: int, target: int) -> int:
        """A state for the shorter matches that ``target`` held together with longer ones."""
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[target]))
        length.append(length[at] + 1)
        link.append(link[target])
        link[target] = copy
        while at >= 0 and nxt[at].get(word) == target:
            nxt[at][word] = copy
            at = link[at]
        return copy

    def _suffix(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a match at ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def matches(self, sequence) -> Iterator[tuple[int, int]]:
        """After each word: the state and length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for word in sequence:
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(word, 0)
            matched = matched + 1 if state else 0
            yield state, matched


class Matcher:
    """Finds the windows of a block of items in hashed documents."""

    def __init__(self, texts: list[str], window: int):
        column = pa.array(texts, pa.large_string())
        items = [w.hashes[w.bounds[d] : w.bounds[d + 1]] for w in words(column, "alnum") for d in range(w.n)]
        every = np.concatenate([*items, np.zeros(0, np.uint64)])
        self.window = window
        self.vocabulary = np.unique(every)
        ids = [np.searchsorted(self.vocabulary, x) for x in items]
        self.automaton = Automaton([x.tolist() for x in ids], window)
        self.least = min([len(x) for x in items if len(x)] + [window])
        pairs = [x[:-1] * len(self.vocabulary) + x[1:] for x in ids if len(x) > 1]
        self.pairs = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]))

    def candidates(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, int]]]:
        """Word ids, and the runs of words that could hold a window: each word and, for windows of
        two words or more, each pair of neighbours occurs in some item."""
        vocabulary = self.vocabulary
        if not len(vocabulary) or not len(hashes):
            return hashes, iter(())
        ids = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = vocabulary[ids] == hashes
        if self.least == 1:
            joined = known[:-1] & known[1:]
        else:
            code = ids[:-1] * len(vocabulary) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, code), max(len(self.pairs) - 1, 0))
            joined = known[:-1] & known[1:] & (self.pairs[at] == code if len(self.pairs) else False)
        inner = bounds[1:-1]
        joined[inner[(inner > 0) & (inner < len(hashes))] - 1] = False
        # Runs of joined neighbours; a lone word is a run of itself.
        edges = np.flatnonzero(~joined)
        starts = np.concatenate(([0], edges + 1))
        ends = np.concatenate((edges + 1, [len(hashes)]))
        good = (ends - starts >= self.least) & known[starts]
        return ids, zip(starts[good].tolist(), ends[good].tolist(), strict=True)

    def find(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first word, word after the last, item) of each window's occurrences, windows that meet united for an item."""
        ids, runs = self.candidates(hashes, bounds)
        auto = self.automaton
        for start, end in runs:
            for i, (state, matched) in enumerate(auto.matches(ids[start:end].tolist()), start + 1):
                if matched >= self.window:
                    for item in auto.window_items[auto._suffix(state, self.window)]:
                        yield i - self.window, i, item
                for n in auto.short_lengths:
                    if n > matched:
                        break
                    for item in auto.short_items.get(auto._suffix(state, n), {}).get(n, ()):
                        yield i - n, i, item


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_MATCHERS: dict[tuple, Matcher] = {}


def _scan(block: list[tuple[str, str]], token: tuple, window: int, text: str, mark: list[str], cut: bool, new: list[str]):
    """A task's function: (mark columns, n_words, spans, items[, text without the hit words])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[token] = Matcher([t for _, t in block], window)
        matcher, names = _MATCHERS[token], [x for x, _ in block]
        for batch in batches:
            column = batch.column(text)
            counts, spans, items, texts = [], [], [], []
            for w in words(column, "alnum"):
                found: dict[int, tuple[list, set]] = {}
                for a, b, item in matcher.find(w.hashes, w.bounds):
                    hit = found.setdefault(int(w.doc[a]), ([], set()))
                    hit[0].append((a, b))
                    hit[1].add(names[item])
                counts += np.diff(w.bounds).tolist()
                for d in range(w.n):
                    at, (own, of) = int(w.bounds[d]), found.get(d, ([], ()))
                    own = _merged(own)
                    spans.append([{"start": a - at, "end": b - at} for a, b in own])
                    items.append(sorted(of))
                    if cut:
                        texts.append(_without(w, d, own))
            out = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
            if cut:
                out.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(m) for m in mark] + out, [*mark, *new])

    return run


def _without(w, d: int, spans: list[tuple[int, int]]) -> str:
    """The document's text from each span's first byte to the next kept word left out."""
    lo, hi = int(w.offsets[d]), int(w.offsets[d + 1])
    if not spans:
        return w.data[lo:hi].tobytes().decode()
    parts, at = [], lo
    for a, b in spans:
        parts.append(w.data[at : w.starts[a]].tobytes())
        at = int(w.starts[b]) if b < w.bounds[d + 1] else hi
    return b"".join([*parts, w.data[at:hi].tobytes()]).decode(errors="replace")


def _trimmed(spans: str, text: str):
    """A task's function: the rows with the words of ``spans`` (word numbers, merged) cut out of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, of = batch.column(text).to_pylist(), batch.column(spans).to_pylist()
            some = [i for i, x in enumerate(of) if x]
            for w in words(pa.array([texts[i] for i in some], pa.large_string()), "alnum"):
                for d in range(w.n):
                    i, at = some[w.first + d], int(w.bounds[d])
                    texts[i] = _without(w, d, [(x["start"] + at, x["end"] + at) for x in of[i]])
            names = [c for c in batch.schema.names if c != spans]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names)

    return run


def _item_rows(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The items as rows (i, t), and the number of blocks that they take."""
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return rows, -(-2 * total // block_bytes) if total > block_bytes else 1


def item_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items as lists of (id, text), each read from Spark on its own and of about ``block_bytes`` at most
    (one longer item alone may exceed it). Items with a null id or text are left out."""
    rows, n = _item_rows(benchmark, item, text, block_bytes)
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r.i, r.t) for r in part.collect()]


def _united(rows: DataFrame, mark: str, text: str, blocks: Iterator[list[tuple[str, str]]], window: int) -> DataFrame:
    """(mark, n_words, spans, items) of each of ``rows``, a written table with distinct ids ``mark`` and texts without
    nulls. Each block's pass is written at once, so that the driver holds one block; all but the first keep
    the rows with hits only."""
    merged = None
    for block in blocks:
        if merged is not None and not block:
            continue
        token = (window, hashlib.sha256(repr(block).encode()).hexdigest())
        run = _scan(block, token, window, text, [mark], False, ["n_words", "spans", "items"])
        part = rows.select(mark, text).mapInArrow(run, f"`{mark}` long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")
        part = written(part if merged is None else part.where(F.size("spans") > 0), "leaks")
        merged = part if merged is None else merged.unionByName(part)
    union = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.expr("cast(array() as array<struct<start:long,end:long>>)"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )
    return merged.groupBy(mark).agg(F.max("n_words").alias("n_words"), union.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: the ``key`` columns, n_words, spans (array of start, end: word numbers of the
    hit words, merged) and items (sorted ids, as strings, of items with occurring windows).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``window``
    consecutive words of an item, or all words of a shorter one; an item without words has none. A null text has
    no words; an empty benchmark hits nothing; an empty table gives an empty one. There is one row for each row of ``docs``,
    whatever the number of blocks: null, repeated and shared keys stay apart. Whole texts count, however long. Other columns don't matter; the new
    names give way to the key's.
    """
    small_batches(docs.sparkSession)
    whole, row = fresh("_whole", key), fresh("_row", key)
    source = docs.select(*key, F.coalesce(F.col(text), F.lit("")).alias(whole))
    names = [fresh(c, key) for c in ("n_words", "spans", "items")]
    _, n = _item_rows(benchmark, item, item_text, block_bytes)
    blocks = item_blocks(benchmark, item, item_text, block_bytes)
    if n > 1:
        stored = written(source.withColumn(row, F.monotonically_increasing_id()), "rows")
        return stored.select(*key, row).join(_united(stored, row, whole, blocks, window).toDF(row, *names), row).select(*key, *names)
    block = next(blocks)
    token = (window, hashlib.sha256(repr(block).encode()).hexdigest())
    run = _scan(block, token, window, whole, key, False, names)
    return source.mapInArrow(run, schema_of(docs.select(*key), f"{names[0]} long", f"{names[1]} array<struct<start:long,end:long>>", f"{names[2]} array<string>"))


def n_hit(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, drop_share: float = DROP_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the hit words cut out of ``text``; a document whose share of hit words exceeds
    ``drop_share`` is dropped. Untouched texts (and null ones) stay as they are. All windows are found on the original
    text, whatever the number of blocks: shares are tested and words cut once. Whole texts count, however long; repeated rows share their fate;
    an empty table or benchmark changes nothing; columns of any name stay as they are.
    """
    small_batches(docs.sparkSession)
    columns = docs.columns
    whole, words_, spans, items, cut, row = (fresh(x, columns) for x in ("_whole", "_n_words", "_spans", "_items", "_cut", "_row"))
    source = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    _, n = _item_rows(benchmark, item, item_text, block_bytes)
    blocks = item_blocks(benchmark, item, item_text, block_bytes)
    if n > 1:
        stored = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        found = _united(stored.select(row, F.coalesce(F.col(text), F.lit("")).alias(whole)), row, whole, blocks, window)
        hit = found.where(F.size("spans") > 0).select(row, F.col("n_words").alias(words_), F.col("spans").alias(spans))
        kept = stored.join(hit, row, "left").where(F.col(spans).isNull() | (n_hit(spans) <= F.col(words_) * drop_share))
        return kept.select(*columns, spans).mapInArrow(_trimmed(spans, text), docs.schema)
    block = next(blocks)
    token = (window, hashlib.sha256(repr(block).encode()).hexdigest())
    run = _scan(block, token, window, whole, columns, True, [words_, spans, items, cut])
    found = source.mapInArrow(run, schema_of(docs, f"{words_} long", f"{spans} array<struct<start:long,end:long>>", f"{items} array<string>", f"{cut} string"))
    kept = found.where(n_hit(spans) <= F.col(words_) * drop_share)
    return kept.select(*[F.when(F.size(spans) > 0, F.col(cut)).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in columns])


def op10_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    hits = n_hit("spans")
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
grams AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS gram
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(p)),
hits AS (SELECT doc_id, p, g.n, item FROM places JOIN grams g USING (n, gram)),
by_doc AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS word FROM hits) GROUP BY doc_id),
by_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN by_doc USING (doc_id) LEFT JOIN by_items USING (doc_id)
"""
