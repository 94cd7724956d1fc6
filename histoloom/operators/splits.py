"""Train, validation and test splits, folds and weights of a commit table.

Commits: hash, label (0 or 1), repo_url, author_date. Every rank ends in the hash, so results don't depend on row
order. Ranks over all rows come from range-partitioned counts, not from one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import comma_list
from ..functions.shared import md5_order, with_global_rank, with_running_sums, written

# Fixed values.
VAL_REPOS = ["ImageMagick/ImageMagick", "radareorg/radare2", "the-tcpdump-group/tcpdump", "php/php-src", "FreeRDP/FreeRDP"]
TEST_REPOS = ["FFmpeg/FFmpeg", "gpac/gpac", "OISF/suricata", "openssl/openssl", "redis/redis", "envoyproxy/envoy"]
FIRST_VAL_REPOS = ["ImageMagick/ImageMagick", "gpac/gpac", "FreeRDP/FreeRDP"]
FIRST_TEST_REPOS = ["openssl/openssl", "FFmpeg/FFmpeg", "krb5/krb5"]
CRITICAL = ["CWE-121", "CWE-787", "CWE-78", "CWE-94"]
HIGH = [
    "CWE-119", "CWE-120", "CWE-122", "CWE-125", "CWE-416", "CWE-415", "CWE-190", "CWE-191", "CWE-824", "CWE-843",
    "CWE-89", "CWE-77", "CWE-134", "CWE-74", "CWE-22", "CWE-287", "CWE-306", "CWE-284", "CWE-285", "CWE-347",
]
LOW = ["CWE-201", "CWE-203", "CWE-209", "CWE-404"]
HARDNESS = {"num_lines_changed": 0.30, "num_files_changed": 0.25, "dmm_unit_size": 0.15, "dmm_unit_complexity": 0.15, "dmm_unit_interfacing": 0.15}


def _named(url: Column, names: Sequence[str]) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | F.coalesce(url.contains(name), F.lit(False))
    return out


def repo_class(url: Column, val: Sequence[str] = VAL_REPOS, test: Sequence[str] = TEST_REPOS) -> Column:
    """Where a repository belongs by substrings of its url; null is train."""
    return F.when(_named(url, test), "test").when(_named(url, val), "val").otherwise("train")


def by_repo(commits: DataFrame, val: Sequence[str] = VAL_REPOS, test: Sequence[str] = TEST_REPOS) -> DataFrame:
    return commits.withColumn("repo_split", repo_class(F.col("repo_url"), val, test))


def by_repo_first(commits: DataFrame) -> DataFrame:
    """The first generation's held-out repositories."""
    return by_repo(commits, FIRST_VAL_REPOS, FIRST_TEST_REPOS)


def _part(rank: Column, total: Column, train: float, val: float, names: Sequence[str]) -> Column:
    """By place from 1 among ``total``; the cuts round down."""
    return F.when(rank <= F.floor(total * train), names[0]).when(rank <= F.floor(total * (train + val)), names[1]).otherwise(names[2])


def _dated_parts(commits: DataFrame, train: float, val: float, names: Sequence[str]) -> DataFrame:
    dated = commits.where("author_date IS NOT NULL").select("hash", "author_date")
    ranked = with_global_rank(dated, [F.col("author_date"), F.col("hash")])
    return ranked.select("hash", _part(F.col("rank"), F.col("total"), train, val, names).alias("repo_split"))


def by_time(commits: DataFrame, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Oldest to train, newest to test; undated commits to train."""
    parts = _dated_parts(commits, train, val, ["train", "val", "test"])
    return commits.drop("repo_split").join(parts, "hash", "left").na.fill("train", ["repo_split"])


def by_repo_and_time(commits: DataFrame, train: float = 0.70, val: float = 0.15, val_repos: Sequence[str] = VAL_REPOS, test_repos: Sequence[str] = TEST_REPOS) -> DataFrame:
    """Held-out repositories whole; of the others the oldest to train, the next to val, the newest left out; undated ones to train."""
    marked = by_repo(commits, val_repos, test_repos)
    pool = marked.where("repo_split = 'train'").drop("repo_split")
    parts = _dated_parts(pool, train, val, ["train", "val", "out"])
    kept = pool.join(parts, "hash", "left").na.fill("train", ["repo_split"]).where("repo_split <> 'out'")
    return kept.unionByName(marked.where("repo_split <> 'train'"))


def by_identity(commits: DataFrame, owners: DataFrame, identity: Sequence[str], train: float = 0.70, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Identities (developers, files, functions) are dealt out in shuffled order; a commit with any test identity is
    test, else with any val identity val, else train. ``owners``: hash and the identity's columns."""
    ids = owners.select(*identity).dropna().distinct()
    ranked = with_global_rank(ids, md5_order(seed, *[F.col(c).cast("string") for c in identity]))
    level = F.when(F.col("rank") <= F.floor(F.col("total") * train), 0).when(F.col("rank") <= F.floor(F.col("total") * (train + val)), 1).otherwise(2)
    worst = owners.join(ranked.select(*identity, level.alias("_level")), list(identity)).groupBy("hash").agg(F.max("_level").alias("_level"))
    name = F.when(F.col("_level") == 2, "test").when(F.col("_level") == 1, "val").otherwise("train")
    return commits.drop("repo_split").join(worst, "hash", "left").withColumn("repo_split", name).drop("_level")


def by_weakness(commits: DataFrame, test: float = 0.20, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Weakness classes (``cwe_id``, a comma list) of positive commits are dealt out; negatives and commits without one to train."""
    owners = commits.where("label = 1").select("hash", F.explode(comma_list(F.col("cwe_id"))).alias("cwe")).distinct()
    return by_identity(commits, owners, ["cwe"], 1 - test - val, val, seed)


def severity(cwe: Column) -> Column:
    """0 to 3; an unknown class is MEDIUM."""
    return F.when(cwe.isin(CRITICAL), 3).when(cwe.isin(HIGH), 2).when(cwe.isin(LOW), 0).otherwise(1)


def by_severity(commits: DataFrame) -> DataFrame:
    """The worst class of a positive commit: HIGH and CRITICAL to test, MEDIUM to val, else train."""
    worst = F.array_max(F.transform(comma_list(F.col("cwe_id")), severity))
    name = F.when((F.col("label") == 1) & (worst >= 2), "test").when((F.col("label") == 1) & (worst == 1), "val").otherwise("train")
    return commits.withColumn("repo_split", name)


def hardness(commits: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``commits`` with hn_score: weighted mean of the columns present, each over its maximum."""
    use = {c: w for c, w in (weights or HARDNESS).items() if c in commits.columns}
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in use}
    tops = commits.agg(*[F.max(value[c]).alias(f"_max_{c}") for c in use])
    score = sum(F.when(F.col(f"_max_{c}") > 0, value[c] / F.col(f"_max_{c}")).otherwise(0.0) * w for c, w in use.items()) / sum(use.values())
    return commits.join(F.broadcast(tops)).withColumn("hn_score", score).drop(*tops.columns)


def by_hard_negatives(commits: DataFrame, share: float = 0.20, weights: dict[str, float] | None = None, val_repos: Sequence[str] = VAL_REPOS, test_repos: Sequence[str] = TEST_REPOS, places: int = 9) -> DataFrame:
    """The hardest negatives to test, the others to train; positives by repository. Scores are ranked rounded to ``places``."""
    scored = hardness(commits, weights)
    negatives = scored.where("label = 0").select("hash", F.round("hn_score", places).alias("s"))
    ranked = with_global_rank(negatives, [F.desc("s"), F.col("hash")])
    hard = ranked.where(F.col("rank") <= F.floor(F.col("total") * share)).select("hash", F.lit(True).alias("_hard"))
    name = F.when(F.col("label") == 1, repo_class(F.col("repo_url"), val_repos, test_repos)).when(F.col("_hard"), "test").otherwise("train")
    return scored.join(hard, "hash", "left").withColumn("repo_split", name).drop("_hard")


def by_graph_size(commits: DataFrame, small: float = 0.50, medium: float = 0.25) -> DataFrame:
    """Small commits (lines and files changed) to train, middling to val, large to test; adds graph_score."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    scored = commits.withColumn("graph_score", zero("num_lines_changed") + zero("num_files_changed"))
    ranked = with_global_rank(scored.select("hash", "graph_score"), [F.col("graph_score"), F.col("hash")])
    share = F.col("rank") / F.col("total")
    parts = ranked.select("hash", F.when(share <= small, "train").when(share <= small + medium, "val").otherwise("test").alias("repo_split"))
    return scored.drop("repo_split").join(parts, "hash")


def cold_start(commits: DataFrame, n_cold: int = 5, few_shot: int = 0, val_repos: Sequence[str] = VAL_REPOS, test_repos: Sequence[str] = TEST_REPOS) -> DataFrame:
    """The smallest repositories of the pool are test too; the earliest ``few_shot`` commits of all of them go to train."""
    marked = by_repo(commits, val_repos, test_repos)
    cold = marked.where("repo_split = 'train' AND repo_url IS NOT NULL").groupBy("repo_url").agg(F.count("*").alias("_n")).orderBy("_n", "repo_url").limit(n_cold)
    marked = marked.join(F.broadcast(cold.select("repo_url", F.lit(True).alias("_cold"))), "repo_url", "left")
    early = marked.where("_cold").select("hash", "author_date").orderBy(F.col("author_date").asc_nulls_last(), "hash").limit(few_shot).select("hash", F.lit(True).alias("_early"))
    name = F.when(F.col("_early"), "train").when(F.col("_cold"), "test").otherwise(F.col("repo_split"))
    return marked.join(F.broadcast(early), "hash", "left").withColumn("repo_split", name).drop("_cold", "_early")


def repo_folds(commits: DataFrame, k: int) -> DataFrame:
    """``commits`` with fold: largest repository first to the fold with the fewest commits, the first on a tie.

    Repositories of one size are dealt as a run. Only the sizes with their numbers meet in one group, no more than the square root of twice the commits;
    a run's pieces, at most ``k``, tell the folds that take turns in them, and a repository's rank in its run picks one."""
    sizes = commits.groupBy("repo_url").agg(F.count("*").alias("_n"))
    runs = sizes.groupBy("_n").agg(F.count("*").alias("_c"))

    def deal(table: pd.DataFrame) -> pd.DataFrame:
        load, pieces = [0] * k, []
        for n, count in table.sort_values("_n", ascending=False)[["_n", "_c"]].itertuples(index=False):
            n, count = int(n), int(count)
            pieces += [(n, first, turns) for first, turns in _turns(load, n, count)]
        return pd.DataFrame(pieces, columns=["_n", "_first", "_turns"])

    pieces = runs.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(deal, "_n long, _first long, _turns array<long>")
    pieces = written(pieces.withColumn("_end", F.coalesce(F.lead("_first").over(Window.partitionBy("_n").orderBy("_first")), F.lit((1 << 63) - 1))), "pieces")
    ranked = with_running_sums(sizes.withColumn("_one", F.lit(1).cast("long")), ["_n"], [F.col("repo_url")], {"_one": "_rank"}).withColumn("_rank", F.col("_rank") - 1)
    dealt = ranked.join(pieces, "_n").where("_rank >= _first AND _rank < _end")
    at = F.pmod(F.col("_rank") - F.col("_first"), F.size("_turns")).cast("int")
    return commits.join(dealt.select("repo_url", F.get("_turns", at).alias("fold")), "repo_url")


def _turns(load: list[int], n: int, count: int) -> list[tuple[int, list[int]]]:
    """(first rank, folds in turn) of the pieces in which ``count`` items of size ``n`` go to the least loaded fold; ``load`` is brought up to date.

    A fold takes its next item when its load is the least, so items come in the order of (load, fold), one of each fold in every stretch of
    ``n`` from the fold's own stretch on."""
    out, given, joined = [], 0, []
    stretches = sorted({x // n for x in load})
    for at, q in enumerate(stretches):
        joined = sorted((f for f in range(len(load)) if load[f] // n <= q), key=lambda f: (load[f] % n, f))
        rounds = stretches[at + 1] - q if at + 1 < len(stretches) else -(-(count - given) // len(joined))
        here = min(rounds * len(joined), count - given)
        out.append((given, joined, here))
        given += here
        if given == count:
            break
    for _, folds, here in out:
        for i, f in enumerate(folds):
            load[f] += n * (here // len(folds) + (i < here % len(folds)))
    return [(first, folds) for first, folds, _ in out]


def leave_one_repo_out(commits: DataFrame, k: int) -> DataFrame:
    """(commit columns, fold, part): a fold for each of the ``k`` largest repositories, that one val and all others train."""
    sizes = commits.where("repo_url IS NOT NULL").groupBy("repo_url").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "repo_url").limit(k)
    folds = sizes.select(F.col("repo_url").alias("_held"), (F.row_number().over(Window.orderBy(F.desc("_n"), "repo_url")) - 1).cast("long").alias("fold"))
    return commits.join(F.broadcast(folds)).withColumn("part", F.when(F.col("repo_url") == F.col("_held"), "val").otherwise("train")).drop("_held")


def walk_forward(commits: DataFrame, k: int) -> DataFrame:
    """(hash, chunk, fold, part): 2k chunks by date; fold i trains on chunks below k + i and validates on chunk k + i."""
    ranked = with_global_rank(commits.where("author_date IS NOT NULL").select("hash", "author_date"), [F.col("author_date"), F.col("hash")])
    chunk = F.least(F.expr(f"(rank - 1) * {2 * k} div total"), F.lit(2 * k - 1))
    chunked = ranked.select("hash", chunk.cast("long").alias("chunk"))
    first = F.greatest(F.col("chunk") - k, F.lit(0))
    every = chunked.withColumn("fold", F.explode(F.sequence(first, F.lit(k - 1).cast("long"))))
    return every.withColumn("part", F.when(F.col("chunk") == F.col("fold") + k, "val").otherwise("train"))


def expanding_folds(commits: DataFrame, k: int) -> DataFrame:
    """(hash, fold, part): as a time series split: test blocks of n div (k + 1) rows at the end, all earlier rows train."""
    ranked = with_global_rank(commits.where("author_date IS NOT NULL").select("hash", "author_date"), [F.col("author_date"), F.col("hash")])
    size = F.expr(f"total div {k + 1}")
    start = lambda fold: F.col("total") - (k - fold) * size
    every = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    begin = start(F.col("fold"))
    return every.where(F.col("rank") <= begin + size).select("hash", "fold", F.when(F.col("rank") <= begin, "train").otherwise("val").alias("part"))


def stratified_holdout(commits: DataFrame, test: float = 0.20, seed: int = 42) -> DataFrame:
    """Shuffled within each label; the first share is test, rounded down."""
    marked = commits.select("hash", "label", F.lit(1).alias("_one"))
    ranked = with_running_sums(marked, ["label"], md5_order(seed, "hash"), {"_one": "_place"}, totals=True)
    parts = ranked.select("hash", F.when(F.col("_place") <= F.floor(F.col("_place_all") * test), "test").otherwise("train").alias("repo_split"))
    return commits.drop("repo_split").join(parts, "hash")


def time_holdout(commits: DataFrame, train: float = 0.80) -> DataFrame:
    parts = _dated_parts(commits, train, 0.0, ["train", "test", "test"])
    return commits.drop("repo_split").join(parts, "hash", "left").na.fill("train", ["repo_split"])


def enriched(split: DataFrame, *more: DataFrame) -> DataFrame:
    """The split with the columns of other tables by hash, its own columns first."""
    for other in more:
        split = split.join(other.select("hash", *[c for c in other.columns if c not in split.columns]), "hash", "left")
    return split


def class_weights(commits: DataFrame) -> DataFrame:
    """``commits`` with class_weight n / (2 n_label) and repo_weight 1 / (n_repo n_repo,label), repositories counted over all rows."""
    by_label = commits.groupBy("label").agg(F.count("*").alias("_nl"))
    n_repos = commits.agg(F.count("*").alias("_n"), F.count_distinct("repo_url").alias("_nr"))
    by_both = commits.groupBy("repo_url", "label").agg(F.count("*").alias("_nrl"))
    out = commits.join(F.broadcast(by_label), "label").join(by_both, ["repo_url", "label"]).join(F.broadcast(n_repos))
    return out.withColumn("class_weight", F.col("_n") / (2 * F.col("_nl"))).withColumn("repo_weight", 1 / (F.col("_nr") * F.col("_nrl"))).drop("_nl", "_n", "_nr", "_nrl")


def label_ratio(commits: DataFrame) -> DataFrame:
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return commits.agg(pos.alias("n_pos"), neg.alias("n_neg"), (neg / pos).alias("neg_pos_ratio"))


def weighted_resample(commits: DataFrame, weight: str, n: int, seed: int = 42, fill: int = 8) -> DataFrame:
    """``n`` draws with replacement in proportion to ``weight``: (draw, hash). Draw i falls at the md5 of the seed and i, as a share of
    all weight; the row whose stretch of the running weight by hash holds that place is drawn.

    Places are dealt into buckets of about ``fill`` rows or draws, which grow in number with both, and a row stands in each bucket that
    its stretch meets; so both sides of the equi-join stay small."""
    rows = commits.select("hash", F.col(weight).cast("double").alias("w")).where("w > 0")
    rows = written(with_running_sums(rows, [], [F.col("hash")], {"w": "top"}, totals=True), "weights")
    buckets = max(1, max(rows.count(), n) // fill)
    bucket = lambda x: F.least(F.floor(x / F.col("top_all") * buckets), F.lit(buckets - 1))
    spans = rows.select("hash", (F.col("top") - F.col("w")).alias("low"), "top", (F.col("top") >= F.col("top_all")).alias("last"), F.explode(F.sequence(bucket(F.greatest(F.col("top") - F.col("w"), F.lit(0.0))), bucket(F.col("top")))).alias("b"))
    unit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    total = rows.agg(F.max("top_all").alias("top_all"))
    draws = commits.sparkSession.range(n).select(F.col("id").alias("draw"), unit.alias("u")).join(F.broadcast(total)).select("draw", (F.col("u") * F.col("top_all")).alias("x"), "top_all").select("draw", "x", bucket(F.col("x")).alias("b"))
    hit = (F.col("x") >= F.col("low")) & ((F.col("x") < F.col("top")) | F.col("last"))
    return draws.join(spans, "b").where(hit).groupBy("draw").agg(F.min("hash").alias("hash"))
