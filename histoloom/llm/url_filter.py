"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

The list holds canonical URLs ``host + path`` with an action each. A listed entry covers its host,
all subdomains, and every path that starts with its path. A page's URL is turned into the canonical
keys that could be listed: the tails of its host of as many labels as a listed host has, joined with its path cut to each
length that a listed path has. Tails pass a Bloom filter of the listed hosts first, so that only they meet the lengths; a filter of
the whole keys passes few of these on; an equi-join with the list removes its false positives; the longest listed key decides.

Only DataFrame functions are used. A filter is a table of one 64-bit word a row, a row for about ``PER_BLOCK`` listed keys and at most
``MOST_BLOCKS`` rows, so broadcasting it is bounded by that parameter. Beyond it results are the same and more keys reach the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fresh, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: host, path, action
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
PER_BLOCK, LEAST_BLOCKS, MOST_BLOCKS = 4, 1 << 10, 1 << 20
PROBES = 4
#: URLs with a larger share of the pages than one in so many, at most so many, are broadcast with their rules.
SHARE = 10_000
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """``PROBES`` bits of one 64-bit word."""
    h = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def blocks_for(keys: int) -> int:
    """Rows of a filter of so many keys: a power of two."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << max(-(-keys // PER_BLOCK) - 1, 0).bit_length()))


def bloom_table(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, word): at most ``blocks`` rows. Null keys are left out."""
    return listed.where(F.col(key).isNotNull()).groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_mask(F.col(key))).alias("word"))


def _passed(rows: DataFrame, key: Column, listed: DataFrame, blocks: int) -> DataFrame:
    """``rows`` whose ``key`` may be one of the column ``key`` of ``listed``."""
    bloom = bloom_table(listed, "key", blocks)
    tested = rows.withColumn("block", _block(key, blocks)).withColumn("mask", _mask(key)).join(F.broadcast(bloom), "block")
    return tested.where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).drop("block", "mask", "word")


def judge_urls(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow", blocks: int | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest listed key that fits, or null) and
    ``verdict`` (its action, or ``default``).

    ``listed``: host, path, action. Keys listed twice: the action that sorts last holds, so
    ``block`` beats ``allow``. Equal length: the longer host wins. A null url or one without
    ``://`` has empty host and path and fits nothing. Of a very long host only the tails of as many labels as some listed host has
    are looked up, of a path only its starts of listed lengths. Repeated rows stay; columns of ``pages`` named like the new
    ones are replaced, others stay whatever their names; an empty table gives an empty one. Copies of a URL are judged once; URLs with
    more than one in ``SHARE`` of all rows meet them by broadcast. ``blocks``: rows of the filters, else as :func:`blocks_for` has it.
    """
    rules = listed.where(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != "")).select(
        F.concat("host", "path").alias("key"), F.col("host").alias("tail"), F.length("path").alias("len"), "action"
    )
    rules = rules.groupBy("key", "tail", "len").agg(F.max("action").alias("action"))
    # One row: the distinct lengths of listed paths and numbers of labels of listed hosts, and the number of keys.
    *sizes, n_keys = rules.agg(F.collect_set("len").alias("lens"), F.collect_set(F.size(F.split("tail", r"\.", -1))).alias("depths"), F.count("*")).first()
    lens, depths = (F.array(*map(F.lit, sorted(x))).cast("array<int>") for x in sizes)
    blocks = blocks or blocks_for(n_keys)

    target = F.col("_url")
    urls = pages.select(F.col(url).alias("_url")).where(target.contains("://")).groupBy("_url").agg(F.count("*").alias("n")).select("_url", "n", host_of(target).alias("h"), path_of(target).alias("p"))
    labels = F.split("h", r"\.", -1)
    tails = F.transform(F.filter(depths, lambda d: d <= F.size(labels)), lambda d: F.array_join(F.slice(labels, F.size(labels) - d + 1, d), "."))
    tailed = urls.withColumn("tail", F.explode(tails)).where(F.col("tail") != "")
    tailed = _passed(tailed, F.col("tail"), rules.select(F.col("tail").alias("key")), blocks)
    keyed = tailed.withColumn("len", F.explode(F.filter(lens, lambda n: n <= F.length("p")))).withColumn("key", F.concat("tail", F.expr("substring(p, 1, len)")))
    possible = _passed(keyed.select("_url", "n", "tail", "len", "key"), F.col("key"), rules, blocks)
    exact = possible.join(rules, ["key", "tail", "len"])
    best = exact.groupBy("_url").agg(F.max(F.struct(F.length("key"), F.length("tail"), F.col("key").alias("rule"), "action")).alias("best"), F.max("n").alias("n"))
    best = written(best, "judged")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    own, fits = (fresh(x, [*kept, "host", "path", "rule", "verdict"]) for x in ("_key", "_best"))
    rows = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(url).alias(own))
    best = best.select(F.col("_url").alias(own), F.col("best").alias(fits), "n")
    heavy = F.col("n") > pages.count() / SHARE
    some = rows.join(F.broadcast(best.where(heavy).drop("n")), own, "left")
    rest = some.where(F.col(fits).isNull()).drop(fits).join(best.where(~heavy).drop("n"), own, "left")
    every = some.where(F.col(fits).isNotNull()).unionByName(rest)
    return every.select(*kept, "host", "path", F.col(f"{fits}.rule").alias("rule"), F.coalesce(F.col(f"{fits}.action"), F.lit(default)).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{host}', '{path}', '{action}')" for host, path, action in RULES)
    listed = spark.sql(f"SELECT * FROM VALUES {rows} AS listed(host, path, action)")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH rules(rh, rp, action) AS (VALUES {rules}),
parts AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{upper}', '{lower}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
judged AS (
  SELECT u.host, u.path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(action, length(rh || rp)) AS action
  FROM (SELECT DISTINCT host, path FROM parts) u JOIN rules ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp)
  GROUP BY u.host, u.path)
SELECT page_id, p.host, p.path, rule, coalesce(action, 'allow') AS verdict
FROM parts p LEFT JOIN judged j ON p.host = j.host AND p.path = j.path
""".format(rules=", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES), upper=UPPER, lower=LOWER)
