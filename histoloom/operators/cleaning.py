"""Cleaning of commit tables: survivors of duplicates, snapshots, renames, imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantile_row
from ..functions.scalars import cyclic, hash_list, local_time


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rare: bool = False) -> DataFrame:
    """The first row of each key by ``order``, which should be total. ``rare``: few keys are repeated, so rows are not also sorted before
    they are dealt, to leave repeats behind."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if rare:
        return df.withColumn("_after", F.lag(F.lit(True)).over(w)).where("_after IS NULL").drop("_after")
    place = F.row_number().over(w)
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def entities_of(entities: DataFrame, commits: DataFrame, link: Sequence[str] = ("fc_hash", "vcc_hash", "matched_anchor", "window_since", "window_until")) -> DataFrame:
    """(hash, entity columns): entities that name a commit by either hash, once each whatever their link columns say."""
    own = [c for c in entities.columns if c not in link]
    named = entities.select(F.explode(F.array_distinct(F.array("fc_hash", "vcc_hash"))).alias("hash"), *own)
    return named.join(commits.select("hash").distinct(), "hash", "left_semi").distinct()


def canonical_snapshots(functions: DataFrame) -> DataFrame:
    """Per commit type the snapshot that counts: after the change, but before it for VCC; of VCC also added and renamed functions after it."""
    vcc, before = F.col("commit_label") == "VCC", F.col("before_change")
    return functions.where((~vcc & ~before) | (vcc & before) | (vcc & ~before & F.col("function_change_type").isin("ADD", "RENAME")))


def snapshots_or_after(functions: DataFrame) -> DataFrame:
    """VCC commits: their rows before the change, or all if there are none; other commits: rows after it, or all."""
    w = Window.partitionBy("hash")
    wanted = F.col("before_change") == (F.col("commit_label") == "VCC")
    return functions.withColumn("_any", F.max(wanted).over(w)).where(wanted | ~F.col("_any")).drop("_any")


def inferred_change(functions: DataFrame) -> DataFrame:
    """``functions`` with function_change_type from the snapshots of (hash, name): only before: DELETE, only after: ADD, both: MODIFY."""
    seen = functions.groupBy("hash", "name").agg(F.bool_and("before_change").alias("_all"), F.bool_or("before_change").alias("_some"))
    kind = F.when(F.col("_all"), "DELETE").when(~F.col("_some"), "ADD").otherwise("MODIFY")
    return functions.drop("function_change_type").join(seen, ["hash", "name"]).withColumn("function_change_type", kind).drop("_all", "_some")


def renamed_after(functions: DataFrame, newer: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """After-rows for VCC renames that have none: where the newer table has exactly one other name in the same (hash, file)."""
    vcc = functions.where("commit_label = 'VCC'")
    before = vcc.where("before_change AND function_change_type = 'RENAME'")
    lonely = before.join(vcc.where("NOT before_change").select("hash", "filename").distinct(), ["hash", "filename"], "left_anti").select("hash", "filename", F.col("name").alias("_old"))
    other = newer.select("hash", "filename", "name", *metrics).join(lonely, ["hash", "filename"]).where("name <> _old")
    alone = other.withColumn("_n", F.count("*").over(Window.partitionBy("hash", "filename", "_old"))).where("_n = 1").drop("_n", "_old")
    return alone.select("hash", "filename", "name", *metrics, F.lit("VCC").alias("commit_label"), F.lit("RENAME").alias("function_change_type"), F.lit(False).alias("before_change"))


def functions_and_hunks(functions: DataFrame, hunks: DataFrame) -> DataFrame:
    """One table over the shared columns, marked by is_hunk."""
    shared = [c for c in functions.columns if c in hunks.columns]
    return functions.select(*shared, F.lit(False).alias("is_hunk")).unionByName(hunks.select(*shared, F.lit(True).alias("is_hunk")))


def of_known_files(functions: DataFrame, files: DataFrame, commits: DataFrame) -> DataFrame:
    """Functions whose file is one of the commit's and whose role is the commit's type."""
    typed = commits.select("hash", F.col("commit_type").alias("commit_label")).distinct()
    return functions.join(files.select("hash", "filename").distinct(), ["hash", "filename"], "left_semi").join(typed, ["hash", "commit_label"], "left_semi")


def fix_of(mapping: DataFrame, order: str) -> DataFrame:
    """(vcc_hash, fc_hash) from rows of fc_hash and a written list of vcc hashes; the last row by ``order`` wins."""
    pairs = mapping.select(F.explode(hash_list(F.col("vcc_hash"))).alias("vcc_hash"), "fc_hash", order).where("fc_hash <> ''")
    return pairs.groupBy("vcc_hash").agg(F.max_by("fc_hash", F.struct(order, "fc_hash")).alias("fc_hash"))


def with_parents(commits: DataFrame) -> DataFrame:
    found = hash_list(F.col("parents"))
    return commits.withColumn("parent_list", found).withColumn("is_merge", F.size(found) > 1)


def local_time_features(commits: DataFrame) -> DataFrame:
    """``commits`` with committer_local, its hour and weekday (Monday is 0) and their cycles; rows without message, dates or zones go."""
    rows = commits.dropna(subset=["msg", "author_date", "committer_date", "author_timezone", "committer_timezone"])
    rows = rows.withColumn("committer_local", local_time(F.col("committer_date").cast("timestamp"), F.col("committer_timezone")))
    rows = rows.withColumns({"hour_local": F.hour("committer_local"), "weekday_local": F.weekday("committer_local")})
    hour, day = cyclic(F.col("hour_local"), 24), cyclic(F.col("weekday_local"), 7)
    return rows.withColumns({"hour_sin": hour[0], "hour_cos": hour[1], "weekday_sin": day[0], "weekday_cos": day[1]})


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = quantile_row(df, columns, 0.5, "_m_")
    return df.join(F.broadcast(row)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns}).drop(*row.columns)


def winsorise(df: DataFrame, columns: Sequence[str], top: float = 0.99) -> DataFrame:
    """Values limited to 0 and the interpolated quantile."""
    row = quantile_row(df, columns, top, "_q_")
    return df.join(F.broadcast(row)).withColumns({c: F.greatest(F.lit(0.0), F.least(F.col(c).cast("double"), F.col(f"_q_{c}"))) for c in columns}).drop(*row.columns)


def z_score(df: DataFrame, columns: Sequence[str], clip: float = 5.0) -> DataFrame:
    """Standard scores by the population deviation, limited to plus and minus ``clip``; 0 for a constant column."""
    row = df.agg(*[F.avg(c).alias(f"_a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    z = {c: F.when(F.col(f"_s_{c}") > 0, F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - F.col(f"_a_{c}")) / F.col(f"_s_{c}")))).otherwise(0.0) for c in columns}
    return df.join(F.broadcast(row)).withColumns(z).drop(*row.columns)


def references(pulls: DataFrame, issues: DataFrame, link: Sequence[str], texts: Sequence[str], number: str = "issue_number") -> DataFrame:
    """(hash, pr_id, issue_id): by link columns that hold issue ids; for pulls without such a link, by #numbers in their texts."""
    direct = None
    if link:
        linked = F.explode(F.array_distinct(F.array(*[F.col(c).cast("string") for c in link])))
        direct = pulls.select("hash", "pr_id", linked.alias("issue_id")).join(issues.select("hash", F.col("issue_id").cast("string").alias("issue_id")), ["hash", "issue_id"], "left_semi")
    numbers = F.explode(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(F.col(t), F.lit("")), F.lit(r"#(\d+)"), F.lit(1)) for t in texts]))))
    rest = pulls if direct is None else pulls.join(direct.select("hash", "pr_id"), ["hash", "pr_id"], "left_anti")
    named = rest.select("hash", "pr_id", numbers.alias("_t")).select("hash", "pr_id", F.col("_t").cast("long").alias("_n")).join(issues.select("hash", F.col(number).cast("long").alias("_n"), F.col("issue_id").cast("string").alias("issue_id")), ["hash", "_n"]).select("hash", "pr_id", "issue_id")
    return (named if direct is None else direct.select("hash", "pr_id", "issue_id").unionByName(named)).distinct()
