"""Audit of how document filters interact: what each removes in every order of applying them.

Four filters look at a text alone. The fifth fails a document whose text a smaller id has: a left-semi join on hash, exact
text and smaller id marks it, and texts leave their scan only where their hash occurs under several ids. The marked ids join those of the other
failures; a document's bits are gathered, and the counts by part and combination of bits give the steps of every order.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .storage import written

#: Hashes of 8 bytes that may be broadcast to the scan of texts; more are joined by a shuffle.
BROADCAST_HASHES = 200_000
#: Copies of one text that are compared with its first id in one task.
HOT_COPIES = 2_000
WORDS = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """The filters that look at the text alone, true where it fails: A few words, B few different words, C many capitals, D certain signs."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n, capitals = F.size(words), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n, "C": 100 * capitals > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def later_copies(docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """The rows of ``docs`` (id, part, h, text) whose text stands under a smaller id too; ``hashed`` has (id, h) of all rows.

    Equal hashes are only candidates. The firsts of the texts, one row a text after combining in the tasks, face the rows; a text of
    more than ``HOT_COPIES`` rows is dealt over several tasks, with its first in each. Rows with a null id neither fail nor make others fail."""
    shared = hashed.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("copies")).where("a < b").select("h", "copies")
    shared = written(shared, "shared-hashes")
    narrow = F.broadcast(shared) if shared.count() <= BROADCAST_HASHES else shared
    rows = docs.join(narrow, "h").withColumn("deals", F.ceil(F.col("copies") / HOT_COPIES).cast("int"))
    rows = written(rows.withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.col("deals")).cast("int")), "copies")
    firsts = rows.groupBy("h", "text").agg(F.min("id").alias("first"), F.max("deals").alias("deals"))
    firsts = firsts.select("h", F.col("text").alias("first_text"), "first", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    same = (rows.h == firsts.h) & (rows.deal == firsts.deal) & (rows.text == firsts.first_text) & (firsts["first"] < rows.id)
    return rows.join(firsts, same, "left_semi").select("id", "part", "h")


def failure_masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, mask, n): how many rows of an id and part fail which filters; bit i of the mask is the i-th letter of ABCDE.

    Null texts are empty; a null part is the empty string. Rows of one id, part and text hash fail alike and make one row here."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(text_filters(F.col("text")).values())]
    alone = written(rows.select("id", "part", "h", sum(bits[1:], bits[0]).alias("mask"), F.lit(1).cast("long").alias("n")), "failures")
    copies = later_copies(rows, alone.select("id", "h")).select("id", "part", "h", F.lit(16).alias("mask"), F.lit(0).cast("long").alias("n"))
    return alone.unionByName(copies).groupBy("id", "part", "h").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n")).drop("h")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part, order of ABCDE and step.

    Every row of ``docs`` is a document, repeated rows too; one is good or toxic if any row of ``labels`` (key, quality, toxic) with its id says 1. Null ids have no label and no copies; null texts count as empty, so
    they are copies of each other; whole texts count, however long; equal ids are no copies of each other. Other columns don't matter;
    an empty table gives an empty one. Results have 600 rows a part, made from at most 128 counts a part.
    """
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(f"is_{c}")
    told = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(one("quality"), one("toxic"))
    masks = failure_masks(docs, key, text, part).join(told, "id", "left").na.fill(0, ["is_quality", "is_toxic"])
    counts = masks.groupBy("part", "mask", "is_quality", "is_toxic").agg(F.sum("n").alias("n"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations("ABCDE")])
    steps = counts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - 65)
    earlier = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.when(i < F.col("step"), bit(F.col("filter_order").substr(i, F.lit(1)))).otherwise(0)), F.lit(0), lambda a, b: a + b)
    steps = steps.withColumns({"letter": F.col("filter_order").substr(F.col("step"), F.lit(1)), "earlier": earlier}).withColumn("bit", bit(F.col("letter")))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("earlier")) > 0
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    lost = fails & ~gone
    by_step = steps.groupBy("part", "filter_order", "step", "letter").agg(
        count(~fails & ~gone).alias("kept"), count(lost).alias("removed"), count(fails & gone).alias("redundant"), count(F.col("mask") == F.col("bit")).alias("unique_fails"), count(lost & (F.col("is_quality") == 1)).alias("good_lost"), count(lost & (F.col("is_toxic") == 1)).alias("toxic_lost")
    )
    return by_step.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
m AS (SELECT doc_id, part, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INTEGER)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(first_id < doc_id, false) AS INTEGER) AS mask FROM d),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a1.x || a2.x || a3.x || a4.x || a5.x AS filter_order, [a1.b, a2.b, a3.b, a4.b, a5.b] AS bits FROM a a1, a a2, a a3, a a4, a a5
  WHERE a1.b + a2.b + a3.b + a4.b + a5.b = 31 AND a1.b | a2.b | a3.b | a4.b | a5.b = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) r(k)),
g AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & bit = 0 AND mask & before = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit > 0 AND mask & before = 0 AND good = 1 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 AND bad = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM g
"""
