"""Fill-in-the-middle transformation: texts cut twice after whole lines and put together in another order.

A text's UTF-8 bytes stand in fixed blocks. Two Fenwick trees hold, by block, the lines that end there and the code points that begin
there. A descent by halving steps finds the block in which a wanted line ends, summing the code points before it on the
way; the end itself is sought in that block alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fresh, small_batches

#: Bytes of a block.
BLOCK = 4096
#: Marks of the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
_NEWLINE = 10


def _begins(data: np.ndarray) -> np.ndarray:
    """The bytes at which a code point begins."""
    return (data & 0xC0) != 0x80


def fenwick(counts: np.ndarray) -> np.ndarray:
    """The Fenwick tree of ``counts``: place i, from 1, has the sum of as many counts up to the i-th as i's lowest bit says."""
    at = np.arange(1, len(counts) + 1)
    sums = np.concatenate(([0], np.cumsum(counts)))
    return np.concatenate(([0], sums[at] - sums[at & (at - 1)]))


class Blocks:
    """The lines (``[^\\n]*\\n|[^\\n]+``) and code points of UTF-8 bytes."""

    def __init__(self, data: np.ndarray, block: int = BLOCK):
        self.data, self.block = data, block
        starts = np.arange(0, len(data), block)
        ends, points = (np.add.reduceat(x, starts, dtype=np.int64) if len(data) else np.zeros(0, np.int64) for x in (data == _NEWLINE, _begins(data)))
        self.ends, self.begun = fenwick(ends), fenwick(points)
        self.lines = int(ends.sum()) + bool(len(data) and data[-1] != _NEWLINE)
        self.points = int(points.sum())

    def cut(self, lines: int) -> tuple[int, int]:
        """The byte and the code point that follow the first ``lines`` lines."""
        if lines <= 0:
            return 0, 0
        if lines >= self.lines:
            return len(self.data), self.points
        at, left, points, step = 0, lines, 0, 1 << (len(self.ends).bit_length() - 1)
        while step:
            there = at + step
            if there < len(self.ends) and self.ends[there] < left:
                at, left, points = there, left - int(self.ends[there]), points + int(self.begun[there])
            step >>= 1
        inside = self.data[at * self.block : (at + 1) * self.block]
        stop = int(np.flatnonzero(inside == _NEWLINE)[left - 1]) + 1
        return at * self.block + stop, points + int(_begins(inside[:stop]).sum())


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 100, spm: int = 50, seed: int = 7, marks: Sequence[str] = MARKS, block: int = BLOCK) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of each row.

    ``n`` counts the text's lines. h1 to h4 are the first four groups of eight hexadecimal digits of the sha256 of ``seed:key``; the
    prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) lines, the middle after the larger. The form is plain (output: the
    text) for an empty text, one that holds a mark, and where h3 % 100 is not below ``rate``; else spm where h4 % 100 is below ``spm``
    (suffix, prefix, middle, each behind its mark), else psm. Lengths are in code points, null for plain rows.

    A null text is empty; a null key counts as no digits; repeated rows are treated alike; whole texts count, however long, in memory
    of a few times one text; an empty table gives an empty one. Other columns don't matter; the new names give way to the key's.
    """
    if len(set(marks)) < 3 or any(a in b for a in marks for b in marks if a != b) or not all(marks):
        raise ValueError("marks must differ, and none may be part of another")
    if any(a[:i] == b[-i:] for a in marks for b in marks for i in range(1, min(len(a), len(b)))):
        raise ValueError("no mark may begin as another, or itself, ends")
    small_batches(docs.sparkSession)
    whole, *drawn = (fresh(c, [key]) for c in ("_whole", "_h1", "_h2", "_h3", "_h4"))
    names = [fresh(c, [key]) for c in ("n", "form", "prefix_chars", "middle_chars", "output")]
    p_mark, s_mark, m_mark = (m.encode() for m in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs = np.stack([batch.column(h).to_numpy() for h in drawn])
            lines, forms, before, between, outputs = [], [], [], [], []
            for i, value in enumerate(batch.column(whole)):
                raw = value.as_buffer().to_pybytes()
                found = Blocks(np.frombuffer(raw, dtype=np.uint8), block)
                h1, h2, h3, h4 = hs[:, i].tolist()
                lines.append(found.lines)
                if not raw or h3 % 100 >= rate or any(m in raw for m in (p_mark, s_mark, m_mark)):
                    forms.append("plain")
                    before.append(None)
                    between.append(None)
                    outputs.append(raw)
                    continue
                a, b = sorted((h1 % (found.lines + 1), h2 % (found.lines + 1)))
                (i1, c1), (i2, c2) = found.cut(a), found.cut(b)
                forms.append("spm" if h4 % 100 < spm else "psm")
                before.append(c1)
                between.append(c2 - c1)
                head, tail = p_mark + raw[:i1], s_mark + raw[i2:]
                outputs.append((tail + head if forms[-1] == "spm" else head + tail) + m_mark + raw[i1:i2])
            made = [pa.array(lines, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(key), *made], [key, *names])

    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    groups = [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(h) for i, h in enumerate(drawn)]
    kind = docs.schema[key].dataType.simpleString()
    types = ("long", "string", "long", "long", "string")
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(whole), *groups).mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"`{n}` {t}" for n, t in zip(names, types, strict=True))]))


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text from which :func:`fill_in_middle` made ``output``: the parts between the marks in their first order."""
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    prefix, suffix = (F.when(form == "spm", parts[b]).otherwise(parts[a]) for a, b in ((1, 2), (2, 1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))


def op11_fenwick_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
