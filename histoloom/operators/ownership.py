"""Ownership of files: window choice, matching of paths, and concentration statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import OWNER_SHARE, basename, log_count


def choose_window(ownership: DataFrame, wanted: int = 90) -> DataFrame:
    """The rows of each commit's window nearest to ``wanted`` days, the smaller one on a tie."""
    near = ownership.groupBy("commit_hash").agg(F.min(F.struct(F.abs(F.col("window_days") - wanted), "window_days")).alias("_w"))
    return ownership.join(near, "commit_hash").where(F.col("window_days") == F.col("_w.window_days")).drop("_w")


def match_files(files: DataFrame, ownership: DataFrame) -> DataFrame:
    """Ownership rows with the ``filename`` of their commit that they belong to: the same path, else the same basename.

    Of a commit's files that share a basename the greatest path is taken. Rows without a file go.
    """
    named = files.select(F.col("hash").alias("commit_hash"), "filename").distinct()
    exact = named.withColumn("file_path", F.col("filename"))
    by_base = named.groupBy("commit_hash", basename(F.col("filename")).alias("_base")).agg(F.max("filename").alias("_other"))
    out = ownership.join(exact, ["commit_hash", "file_path"], "left").withColumn("_base", basename(F.col("file_path"))).join(by_base, ["commit_hash", "_base"], "left")
    return out.withColumn("filename", F.coalesce("filename", "_other")).where("filename IS NOT NULL").drop("_base", "_other")


def file_ownership(matched: DataFrame, least: float = OWNER_SHARE) -> DataFrame:
    """(hash, filename, owners, max_ratio, hhi, total): log count of owners with at least ``least``, greatest share,
    sum of squared shares, log of total lines; negative shares count as 0."""
    share = F.greatest(F.coalesce(F.col("ownership_ratio"), F.lit(0.0)), F.lit(0.0))
    return matched.groupBy(F.col("commit_hash").alias("hash"), "filename").agg(
        F.log1p(F.count_if(share >= least).cast("double")).alias("owners"), F.max(share).alias("max_ratio"), F.sum(share * share).alias("hhi"), log_count(F.max("total_lines")).alias("total")
    )


def file_ownership_with_author(matched: DataFrame, roles: DataFrame) -> DataFrame:
    """(hash, filename, owners, hhi, max_ratio, author_ratio): all owners count; the author's own share, 0 if
    the author owns nothing. Of an author's several rows the first by email counts."""
    authors = roles.where("role = 'author'").select("commit_hash", F.col("dev_id").alias("dev_email"), F.lit(True).alias("_author")).distinct()
    marked = matched.join(authors, ["commit_hash", "dev_email"], "left")
    ratio = F.col("ownership_ratio")
    return marked.groupBy(F.col("commit_hash").alias("hash"), "filename").agg(
        F.log1p(F.count_distinct("dev_email").cast("double")).alias("owners"), F.sum(ratio * ratio).alias("hhi"), F.max(ratio).alias("max_ratio"),
        F.coalesce(F.min_by(F.when(F.col("_author"), ratio), F.when(F.col("_author"), F.col("dev_email"))), F.lit(0.0)).alias("author_ratio"),
    )


def commit_file_edges(files: DataFrame, stats: DataFrame) -> DataFrame:
    """commit to file with ownership attributes, 0 where none is known."""
    names = ["owners", "max_ratio", "hhi", "total"]
    return files.select("hash", "filename").distinct().join(stats, ["hash", "filename"], "left").na.fill(0.0, names)


def concentration(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean ownership statistics of the files touched, by repository and label."""
    return commits.join(edges, "hash").groupBy("repo_url", "label").agg(
        F.count("*").alias("n_files"), F.avg("hhi").alias("mean_hhi"), F.avg("max_ratio").alias("mean_max_ratio"), F.avg("owners").alias("mean_owners")
    )


