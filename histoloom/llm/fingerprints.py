"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

Every shingle is hashed once. The top bits choose one of ``BINS`` bins, the rest compete for the bin's
minimum. An empty bin copies a filled one, chosen by a hash of the bin and the attempt alone, so
equal sets fill alike. The low ``BITS`` bits of each bin are kept, packed, and the likeness of two
fingerprints takes off the share of bins that agree by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import Words, code_points, mix, shingles, utf8, words
from .storage import fresh, schema_of, shuffle_partitions, small_batches

BINS = 512  # a power of two
BITS = 4  # divides 8
SHINGLE = 5
#: Rows whose edited texts a task holds at once.
SLICE = 1000
#: Rows of the sample, for each part, whose keys cut the parts.
SAMPLED = 50
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Attempts that all empty bins make at once, and attempts in the table of turns.
_FIRST, _ATTEMPTS = 8, 4096


@lru_cache(maxsize=_FIRST)
def _donors(bins: int, attempt: int) -> np.ndarray:
    """The bin that each empty bin turns to at this attempt: it depends on nothing else, so equal sets fill alike."""
    at = np.arange(bins, dtype=np.uint64)
    return (mix(at * np.uint64(0x1000003) + np.uint64(attempt * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) % np.uint64(bins)).astype(np.int64)


@lru_cache
def _turns(bins: int) -> np.ndarray:
    """For each bin (row) the attempt at which it first turns to each other bin; those it doesn't turn to in time come last, by number."""
    at = np.arange(bins)
    turns = np.broadcast_to(_ATTEMPTS + 1 + at, (bins, bins)).astype(np.int32)
    for attempt in range(_ATTEMPTS, 0, -1):
        turns[at, _donors.__wrapped__(bins, attempt)] = attempt
    return turns


def _densified(least: np.ndarray, bins: int) -> np.ndarray:
    """Fills the empty bins of the rows that have a filled one: each from the first filled bin that it turns to."""
    filled = least != _EMPTY
    rows, at = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    out = least.copy()
    for attempt in range(1, _FIRST + 1):
        donor = _donors(bins, attempt)[at]
        got = filled[rows, donor]
        out[rows[got], at[got]] = least[rows[got], donor[got]]
        rows, at = rows[~got], at[~got]
    # What is left lies in rows of few filled bins: the earliest of those in each bin's turns.
    if len(rows):
        turns, cuts = _turns(bins), np.flatnonzero(np.diff(rows)) + 1
        for own, row in zip(np.split(at, cuts), rows[np.concatenate(([0], cuts))].tolist(), strict=True):
            some = np.flatnonzero(filled[row])
            out[row, own] = least[row, some[turns[own[:, None], some].argmin(axis=1)]]
    return out


def _packed(w: Words, bins: int, bits: int, k: int) -> list[bytes]:
    h, doc = shingles(w, k)
    least = np.full(w.n * bins, _EMPTY)
    width = np.uint64(bins.bit_length() - 1)
    np.minimum.at(least, doc * bins + (h >> (np.uint64(64) - width)).astype(np.int64), h & ((np.uint64(1) << (np.uint64(64) - width)) - np.uint64(1)))
    least = _densified(least.reshape(w.n, bins), bins)
    # The bin goes into its bits, so the bins that copy one value don't agree with another's by one chance.
    least = mix(least ^ mix(np.arange(1, bins + 1, dtype=np.uint64)))
    low = (least & np.uint64((1 << bits) - 1)).astype(np.uint8).reshape(w.n, -1, 8 // bits)
    code = np.zeros(low.shape[:2], dtype=np.uint8)
    for i in range(8 // bits):
        code |= low[:, :, i] << np.uint8(8 - bits * (i + 1))
    have = np.diff(w.bounds) > 0
    return [row.tobytes() if ok else b"" for row, ok in zip(code, have, strict=True)]


def fingerprints_of(column: pa.Array, bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> list[bytes]:
    """A packed fingerprint for each text of a string column without nulls; b'' for a text without words."""
    return [x for w in words(column, "space") for x in _packed(w, bins, bits, k)]


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1, corrected for chance agreement.
    Two empty fingerprints are alike (1); an empty one and another are not (0)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    agree = sum(int(((x >> np.uint8(s)) & np.uint8((1 << bits) - 1) == 0).sum()) for s in range(0, 8, bits)) / bins
    chance = 1 / (1 << bits)
    return max(0.0, (agree - chance) / (1 - chance))


def fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint", bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> DataFrame:
    """``docs`` with a binary fingerprint of the ``k``-word shingles of ``text`` (words
    ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer than ``k`` words are one shingle).

    A null text counts as empty; a text without words has an empty fingerprint; equal texts have
    equal ones; repeated rows stay; a column named ``into`` is replaced; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c != into]
    whole = fresh("_whole", columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(fingerprints_of(batch.column(whole), bins, bits, k), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [found], [*columns, into])

    return docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias(whole)).mapInArrow(run, schema_of(docs.select(*columns), f"{into} binary"))


def _before(cuts: np.ndarray, key: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the sorted pairs ``cuts`` (2 columns) are less than each pair of key and tie, and how many no greater."""
    low, high = (np.searchsorted(cuts[:, 0], key, side=side) for side in ("left", "right"))
    less, least = low.copy(), low.copy()
    for i in np.unique(low[high > low]).tolist():
        rows = np.flatnonzero((low == i) & (high > low))
        ties = cuts[i : high[rows[0]], 1]
        less[rows] += np.searchsorted(ties, tie[rows], side="left")
        least[rows] += np.searchsorted(ties, tie[rows], side="right")
    return less, least


def with_next(docs: DataFrame, key: str, text: str, partitions: int) -> tuple[DataFrame, dict[str, str]]:
    """Deals ``docs`` out by descending ``key`` so that each task can pair every row with the next one.

    Adds four columns, whose names (the second result tells them) give way to those of ``docs``: ``order``, the key, a null as the
    least value; ``tie``, a hash of the text, which orders rows of one key, so that a much repeated key spans parts; ``part`` and
    ``guest``. Rows go to parts cut between pairs of order and tie of a sample of about ``SAMPLED`` rows a part. The first row of a
    part also goes, as a guest, to the part before it (the very first to the last part), so each part ends with the row that follows it.
    Equal rows that fill several parts are dealt over them, with one more of them as each one's guest. The driver gets the sample
    and one pair for each part. An empty table gives an empty one; texts, null or long, are only hashed here.
    """
    small_batches(docs.sparkSession)
    names = {x: fresh(f"_{x}", docs.columns) for x in ("order", "tie", "part", "guest")}
    order, tie = names["order"], names["tie"]
    ordered = docs.withColumns({order: F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), tie: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    pairs = ordered.select(order, tie)
    share = min(1.0, SAMPLED * partitions / max(1, docs.count()))
    sample = pairs.where(F.rand(5) < share).toArrow()
    picked = np.stack([sample.column(c).to_numpy() for c in (order, tie)], 1)
    picked = picked[np.lexsort((picked[:, 1], picked[:, 0]))]
    cuts = picked[[len(picked) * i // partitions for i in range(1, partitions)]] if len(picked) else picked

    def places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The last part that each row may go to, and how many parts before it may hold it as well."""
        less, least = _before(cuts, batch.column(order).to_numpy(), batch.column(tie).to_numpy())
        wide = np.maximum(least - less - 1, 0)
        return len(cuts) - least + wide, wide

    def tops(batches):
        for batch in batches:
            found = pa.table([pa.array(places(batch)[0]), batch.column(order), batch.column(tie)], names=["p", "k", "t"]).sort_by([("k", "descending"), ("t", "descending")])
            _, first = np.unique(found.column("p").to_numpy(), return_index=True)
            yield from found.take(pa.array(first)).combine_chunks().to_batches()

    heads = {r.p: (r.m.k, r.m.t) for r in pairs.mapInArrow(tops, "p long, k long, t long").groupBy("p").agg(F.max(F.struct("k", "t")).alias("m")).collect()}
    parts = sorted(heads)
    hosts: dict[tuple[int, int], set[int]] = {}
    for i, p in enumerate(parts):
        k, t = heads[p]
        less, least = _before(cuts, np.array([k]), np.array([t]))
        # The part before; the last for the first. Of rows that fill several parts, all of these but the last.
        hosts[k, t] = {parts[i - 1], *range(p - max(int(least[0] - less[0]) - 1, 0), p)}
    firsts = np.array([k for k, _ in hosts], dtype=np.int64)

    def deal(batches):
        dealt_out, sent = 0, set()
        for batch in batches:
            keys, ties = batch.column(order).to_numpy(), batch.column(tie).to_numpy()
            own, wide = places(batch)
            for i in np.flatnonzero(wide).tolist():  # a task's first such row goes to the last part, which so has one
                own[i] -= dealt_out % (wide[i] + 1)
                dealt_out += 1
            rows, part = list(range(len(keys))), own.tolist()
            for i in np.flatnonzero(np.isin(keys, firsts)).tolist():
                pair = int(keys[i]), int(ties[i])
                if pair in hosts and pair not in sent:
                    sent.add(pair)
                    rows += [i] * len(hosts[pair])
                    part += sorted(hosts[pair])
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(part, pa.int32()), pa.array(np.arange(len(rows)) >= len(keys))], [*out.schema.names, names["part"], names["guest"]])

    return ordered.mapInArrow(deal, schema_of(ordered, f"`{names['part']}` int", f"`{names['guest']}` boolean")), names


def _edited(text: str, n: int, following: str) -> str:
    k = n // 3
    return text[: n - k] + following[:k]


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole parts in order, each part closed by a guest: pairs each row with the next."""
    held = None
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, len(b), SLICE)):
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        held = batch.slice(len(batch) - 1)
        if len(batch) < 2:
            continue
        texts = batch.column("_text")
        guest = batch.column("_guest").to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(~guest[:-1])
        if not len(rows):
            continue
        n = code_points(*utf8(texts))
        new, digest = [], []
        for i in rows.tolist():
            new.append(_edited(texts[i].as_py(), int(n[i]), texts[i + 1].as_py()))
            digest.append(hashlib.sha256(new[-1].encode()).hexdigest())
        edited = fingerprints_of(pa.array(new, pa.large_string()))
        own = fingerprints_of(texts)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(rows)), pa.array(n[rows].astype(np.int64)), pa.array(digest), pa.array([own[i].hex() for i in rows]), pa.array([x.hex() for x in edited]),
                pa.array([likeness(own[i], x) for i, x in zip(rows, edited, strict=True)], pa.float64()), pa.array([likeness(own[i], own[i + 1]) for i in rows], pa.float64()),
            ],
            _OUT,
        )


def op1_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    dealt, name = with_next(docs, "doc_id", "_text", 4 * shuffle_partitions(spark))
    ordered = dealt.repartition(name["part"]).sortWithinPartitions(name["part"], name["guest"], F.desc(name["order"]), F.desc(name["tie"]))
    return ordered.select("doc_id", "_text", F.col(name["guest"]).alias("_guest")).mapInArrow(
        _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
