"""Reading and writing of change-history tables: tolerant scans, key filters, merges of generations, graph and report sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .schemas import SCHEMAS


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str | None:
    """The first path that is there: newest generation first."""
    return next((p for p in paths if exists(spark, p)), None)


def read_csv(spark: SparkSession, path: str | None, schema: str, line_breaks: bool = True) -> DataFrame:
    """A CSV table with header, by column name: of the schema's columns those in the file, absent ones null; text may hold line
    breaks and quotes. An absent path gives an empty table.

    Only the columns asked for are parsed. A file whose texts may hold line breaks can't be split: one task reads it. Where they don't,
    say so by ``line_breaks``, and many do."""
    empty = spark.createDataFrame([], schema)
    if path is None or not exists(spark, path):
        return empty
    raw = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').csv(path)
    return raw.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in empty.schema])


def load_tables(spark: SparkSession, folder: str, names: Sequence[str] | None = None, generations: Sequence[str] = ("_full", "_v4", "_v3", ""), line_breaks: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The known tables in a folder, each from its newest CSV generation, or Parquet where there is one; empty where neither is.
    ``line_breaks``: the tables whose CSV texts may hold line breaks, by default all."""
    out = {}
    for name in names or SCHEMAS:
        parquet = f"{folder}/{name}.parquet"
        if exists(spark, parquet):
            found = spark.read.parquet(parquet)
            out[name] = pruned(found, [f.split()[0] for f in SCHEMAS[name].split(", ")])
        else:
            out[name] = read_csv(spark, first_existing(spark, [f"{folder}/{name}{g}.csv" for g in generations]), SCHEMAS[name], line_breaks is None or name in line_breaks)
    return out


def pruned(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that are there."""
    return df.select(*[c for c in wanted if c in df.columns])


def of_hashes(df: DataFrame, hashes: DataFrame, dropped: Sequence[str] = (), link: Sequence[str] = ("fc_hash", "vcc_hash")) -> DataFrame:
    """Rows that name a requested hash (column hash) in either link column, without the dropped columns."""
    wanted = hashes.select("hash").distinct()
    rows = df.drop(*dropped)
    out = rows
    for c in link:
        out = out.join(wanted.select(F.col("hash").alias(c), F.lit(True).alias(f"_in_{c}")), c, "left")
    keep = F.lit(False)
    for c in link:
        keep = keep | F.col(f"_in_{c}").isNotNull()
    return out.where(keep).select(rows.columns)


def gap_filled(old: DataFrame, new: DataFrame, key: str = "hash") -> DataFrame:
    """``old`` and, on its columns, the rows of ``new`` whose key it lacks."""
    rest = new.join(old.select(key).distinct(), key, "left_anti")
    return old.unionByName(pruned(rest, old.columns), allowMissingColumns=True)


def merged(old: DataFrame, new: DataFrame, renamed: dict[str, str] | None = None, key: str = "hash") -> DataFrame:
    """Old rows win; new ones, with columns renamed, only for unseen keys."""
    return old.unionByName(new.withColumnsRenamed(renamed or {"time_since_last_tag": "days_since_prev_tag"}).join(old.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def counts_of(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))


def read_run_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON files of runs with run and seed from their paths: .../<run>/seed_<n>/file.json, or .../<run>/file.json with seed null."""
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("_path", F.col("_metadata.file_path"))
    seed = F.regexp_extract("_path", r"/seed_?(\d+)/[^/]+$", 1).try_cast("int")
    run = F.when(seed.isNotNull(), F.regexp_extract("_path", r"/([^/]+)/seed_?\d+/[^/]+$", 1)).otherwise(F.regexp_extract("_path", r"/([^/]+)/[^/]+$", 1))
    return rows.withColumn("run", run).withColumn("seed", seed).drop("_path")


def write_split(split: DataFrame, path: str, strategy: str) -> None:
    """The split index, a folder a strategy."""
    columns = [c for c in ("hash", "label", "repo_url", "repo_split", "author_date", "hn_score", "graph_score") if c in split.columns]
    split.select(*columns).write.mode("overwrite").parquet(f"{path}/strategy={strategy}")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One Parquet table a node type and a relation, by partition column."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def write_observed(df: DataFrame, path: str, part: str, counts: dict[str, Column]) -> dict[str, int]:
    """Writes ``df`` as :func:`write_graphs` does and returns aggregates over its rows, taken by the tasks that write them. A task that
    runs again counts once."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in counts.items()]).write.mode("overwrite").partitionBy(part).parquet(path)
    return seen.get


def split_rejects(commits: DataFrame, features: DataFrame, files: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(buildable, rejected): commits that can't be built, with the first reason that holds."""
    has = lambda t, n: t.select("hash", F.lit(True).alias(n)).distinct()
    rows = commits.join(has(features, "_x"), "hash", "left").join(has(files, "_f"), "hash", "left").join(has(functions, "_n"), "hash", "left")
    reason = F.when(F.col("commit_type").isNull(), "missing_commit_info").when(F.col("_x").isNull(), "missing_commit_features").when(F.col("_f").isNull() & F.col("_n").isNull(), "no_code_rows").when(F.col("_f").isNull(), "orphan_no_file_info")
    marked = rows.withColumn("reason", reason).drop("_x", "_f", "_n")
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL").select("hash", "reason")


def to_build(commits: DataFrame, done: DataFrame | None = None, overwrite: bool = False, limit: int | None = None, hashes: Sequence[str] | None = None) -> DataFrame:
    """Commits still to be built: those not in the manifest, of the named ones, the first ``limit`` by hash."""
    rows = commits if hashes is None else commits.where(F.col("hash").isin(list(hashes)))
    if done is not None and not overwrite:
        rows = rows.join(done.select("hash"), "hash", "left_anti")
    return rows if limit is None else rows.orderBy("hash").limit(limit)
