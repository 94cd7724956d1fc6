"""The change graph across commits: evolution of files and functions, renames, parents, order in time, and commit selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DEVELOPER_AT_COMMIT, FUNCTION_CHANGES, basename, floor_days, log_count, one_hot, safe_double, signed_log
from ..functions.shared import with_global_rank
from ..functions.vectors import vector_means
from .nodes import best_developer_rows


def repo_commits(commits: DataFrame, url: str) -> DataFrame:
    """A repository's commits, oldest first, undated ones first of all."""
    return commits.where(F.col("repo_url") == url).orderBy(F.col("author_date").asc_nulls_first(), "hash")


def padded_union(*nodes: DataFrame) -> DataFrame:
    """Node tables as one, their vectors padded with zeros to the widest."""
    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    widest = every.agg(F.max(F.size("x")).alias("_w"))
    padded = every.join(F.broadcast(widest)).withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.col("_w") - F.size("x"))))
    return padded.drop("_w")


def dense_ids(nodes: DataFrame, key: str = "node_key") -> DataFrame:
    """``nodes`` with an id from 0 by (hash, key), for export."""
    return with_global_rank(nodes, [F.col("hash"), F.col(key)]).withColumn("id", F.col("rank") - 1).drop("rank", "total")


def shared_developers(emails: DataFrame, info: DataFrame | None, columns: Sequence[str] = DEVELOPER_AT_COMMIT) -> DataFrame:
    """(node_key, x): each developer of ``emails`` (node_key) once, with the log values of ``columns`` in the row of the email in ``info`` that
    has the most commits; absent columns and missing values are 0. Developers without any take the mean of the others."""
    zero = F.array_repeat(F.lit(0.0), len(columns))
    people = emails.select("node_key").distinct()
    if info is None or not any(c in info.columns for c in columns):
        return people.select("node_key", zero.alias("x"))
    known = best_developer_rows(info).select(F.col("email").alias("node_key"), F.array(*[log_count(safe_double(info, c)) for c in columns]).alias("x"))
    return impute_empty(people.join(known, "node_key", "left").select("node_key", F.coalesce("x", zero).alias("x")))


def impute_empty(nodes: DataFrame) -> DataFrame:
    """Vectors that sum to 0 become the mean of the others, place by place; where all do they stay."""
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    mean = vector_means(nodes.where(total > 0), []).select(F.col("x").alias("_mean"))  # one row, as wide as a vector
    return nodes.join(F.broadcast(mean)).withColumn("x", F.when((total > 0) | (F.size("_mean") == 0), F.col("x")).otherwise(F.col("_mean"))).drop("_mean")


def named_files(files: DataFrame) -> DataFrame:
    """``files`` with the new path where there is no filename."""
    if "new_path" not in files.columns:
        return files
    return files.withColumn("filename", F.coalesce(F.nullif("filename", F.lit("")), "new_path"))


def with_kind(functions: DataFrame) -> DataFrame:
    """``functions`` with ``function_change_type`` in capitals and without blanks, null where the table has none."""
    kind = F.upper(F.trim("function_change_type")) if "function_change_type" in functions.columns else F.lit(None).cast("string")
    return functions.withColumn("function_change_type", kind)


def _evolution(rows: DataFrame, key: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """Each row with the next one of its key, where that is of another commit. Rows without a key, or with an empty one, are left out."""
    for k in key:
        rows = rows.where(F.col(k).isNotNull() & (F.col(k) != ""))
    following = F.lead(F.struct("hash", "author_date", "_known", *keep)).over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("next", following).where(F.col("next").isNotNull() & (F.col("next.hash") != F.col("hash")))


def _dated(rows: DataFrame, commits: DataFrame | None) -> DataFrame:
    """``rows`` with their commit's date, 1970 where it has none (``_known`` tells). Without ``commits`` they hold repository and date themselves."""
    date = F.col("author_date").cast("timestamp")
    if commits is None:
        return rows.withColumn("_known", date.isNotNull()).withColumn("author_date", F.coalesce(date, F.timestamp_seconds(F.lit(0))))
    dates = commits.select("hash", "repo_url", F.coalesce(date, F.timestamp_seconds(F.lit(0))).alias("author_date"), date.isNotNull().alias("_known"))
    return rows.join(dates, "hash")


def log_gap(a: Column, b: Column) -> Column:
    """Log of the whole days between two times, 0 where either is unknown."""
    return F.coalesce(F.log1p(F.abs(floor_days(b, a)).cast("double")), F.lit(0.0))


def _gap() -> Column:
    return F.when(F.col("_known") & F.col("next._known"), log_gap(F.col("author_date"), F.col("next.author_date"))).otherwise(0.0)


def _change(rows: DataFrame, column: str, old: str, new: str) -> Column:
    """Signed log of a column's new value less its old one, both under a struct's name; missing values count as 0."""
    if column not in rows.columns:
        return F.lit(0.0)
    zero = lambda side: F.coalesce(F.col(f"{side}{column}").cast("double"), F.lit(0.0))
    return signed_log(zero(new) - zero(old))


def _delta(rows: DataFrame, column: str) -> Column:
    return _change(rows, column, "", "next.")


def fix_gaps(pairs: DataFrame, commits: DataFrame) -> DataFrame:
    """(vcc_hash, fc_hash, gap): pairs of which both commits are in the table, with the log of the days between them."""
    date = lambda side: commits.select(F.col("hash").alias(f"{side}_hash"), F.col("author_date").cast("timestamp").alias(f"_{side}"))
    return pairs.join(date("vcc"), "vcc_hash").join(date("fc"), "fc_hash").select("vcc_hash", "fc_hash", log_gap(F.col("_vcc"), F.col("_fc")).alias("gap"))


def _own_repo(commits: DataFrame | None) -> list[str]:
    return ["repo_url"] if commits is None else []


FILE_MEASURES = ("complexity", "num_lines_of_code", "token_count")
FUNCTION_MEASURES = ("complexity", "num_lines_of_code")
_DELTAS = ("d_complexity", "d_lines", "d_tokens")


def file_evolution(files: DataFrame, commits: DataFrame | None, scoped: bool = True) -> DataFrame:
    """(filename, src, dst, d_complexity, d_lines, d_tokens, gap): a file's consecutive commits; undated ones come first and have no gap.
    ``scoped``: within a repository. Without ``commits`` the files hold repo_url and author_date, and repo_url comes first.

    Of two rows of one commit that follow each other there is no edge, nor one around them. A row without a filename goes by its new path,
    one without either is left out."""
    rows = _dated(named_files(files), commits)
    key = ["repo_url", "filename"] if scoped else ["filename"]
    pairs = _evolution(rows, key, [F.col("author_date"), F.col("hash")], [c for c in FILE_MEASURES if c in files.columns])
    return pairs.select(*_own_repo(commits), "filename", F.col("hash").alias("src"), F.col("next.hash").alias("dst"), *[_delta(files, c).alias(d) for c, d in zip(FILE_MEASURES, _DELTAS, strict=True)], _gap().alias("gap"))


def function_evolution(functions: DataFrame, commits: DataFrame | None, scoped: bool = True) -> DataFrame:
    """(name, src, src_file, dst, dst_file, kind, d_complexity, d_lines, gap): a function's consecutive snapshots by name; kind is the source's change type one-hot.
    Without ``commits`` as in :func:`file_evolution`."""
    rows = _dated(with_kind(functions), commits)
    key = ["repo_url", "name"] if scoped else ["name"]
    pairs = _evolution(rows, key, [F.col("author_date"), F.col("hash"), F.col("filename")], ["filename", *[c for c in FUNCTION_MEASURES if c in functions.columns]])
    return pairs.select(
        *_own_repo(commits), "name", F.col("hash").alias("src"), F.col("filename").alias("src_file"), F.col("next.hash").alias("dst"), F.col("next.filename").alias("dst_file"), one_hot(F.col("function_change_type"), FUNCTION_CHANGES, "MODIFY").alias("kind"),
        *[_delta(functions, c).alias(d) for c, d in zip(FUNCTION_MEASURES, _DELTAS, strict=False)], _gap().alias("gap"),
    )


def file_renames(files: DataFrame, pairs: DataFrame, evolution: DataFrame, commits: DataFrame) -> DataFrame:
    """(src, src_file, dst, dst_file, d_complexity, d_lines, d_tokens, gap): files of a vcc commit that evolve no further and are missing from
    its fix, to every file of the fix."""
    files = named_files(files).where("filename IS NOT NULL AND filename <> ''")
    measures = [c for c in FILE_MEASURES if c in files.columns]
    snapshot = F.struct("filename", *measures)
    old = files.select(F.col("hash").alias("vcc_hash"), F.col("filename").alias("src_file"), snapshot.alias("old")).join(fix_gaps(pairs, commits), "vcc_hash")
    old = old.join(evolution.select(F.col("src").alias("vcc_hash"), F.col("filename").alias("src_file")), ["vcc_hash", "src_file"], "left_anti")
    there = files.select(F.col("hash").alias("fc_hash"), F.col("filename").alias("dst_file"), snapshot.alias("new"))
    old = old.join(there.select("fc_hash", F.col("dst_file").alias("src_file")), ["fc_hash", "src_file"], "left_anti")
    deltas = [_change(files, c, "old.", "new.").alias(d) for c, d in zip(FILE_MEASURES, _DELTAS, strict=True)]
    return old.join(there, "fc_hash").select(F.col("vcc_hash").alias("src"), "src_file", F.col("fc_hash").alias("dst"), "dst_file", *deltas, "gap")


def renames_within(functions: DataFrame) -> DataFrame:
    """(hash, filename, old, new, d_complexity, d_lines): the last renamed function of a file before and after the change, by start line and name."""
    rows = with_kind(functions).where("function_change_type = 'RENAME'")
    snapshot = F.struct("name", *[c for c in FUNCTION_MEASURES if c in functions.columns])
    last = lambda before: rows.where(F.col("before_change") == before).groupBy("hash", "filename").agg(F.max_by(snapshot, F.struct("start_line", "name")).alias("_old" if before else "_new"))
    deltas = [_change(functions, c, "_old.", "_new.").alias(d) for c, d in zip(FUNCTION_MEASURES, _DELTAS, strict=False)]
    return last(True).join(last(False), ["hash", "filename"]).select("hash", "filename", F.col("_old.name").alias("old"), F.col("_new.name").alias("new"), *deltas)


def function_rename_fallback(functions: DataFrame, pairs: DataFrame, commits: DataFrame, *outgoing: DataFrame) -> DataFrame:
    """(src, filename, src_name, dst, dst_name, gap): renamed functions of a vcc commit without an outgoing edge (hash, filename, name), to
    all functions of the file in the fix, a commit of type FC."""
    of = lambda kind: functions.join(commits.where(F.col("commit_type") == kind).select("hash"), "hash", "left_semi")
    rows = with_kind(of("VCC")).where("function_change_type = 'RENAME'").select(F.col("hash").alias("vcc_hash"), "filename", F.col("name").alias("src_name")).distinct()
    for edges in outgoing:
        rows = rows.join(edges.select(F.col("hash").alias("vcc_hash"), "filename", F.col("name").alias("src_name")), ["vcc_hash", "filename", "src_name"], "left_anti")
    targets = of("FC").select(F.col("hash").alias("fc_hash"), "filename", F.col("name").alias("dst_name")).distinct()
    return rows.join(fix_gaps(pairs, commits), "vcc_hash").join(targets, ["fc_hash", "filename"]).select(F.col("vcc_hash").alias("src"), "filename", "src_name", F.col("fc_hash").alias("dst"), "dst_name", "gap")


def parent_edges(commits: DataFrame) -> DataFrame:
    """(src, dst, log_days, is_merge): each parent in the table to its child. ``parent_list`` holds the parents' hashes."""
    rows = commits.select("hash", "author_date", F.explode("parent_list").alias("parent"), (F.size("parent_list") > 1).cast("int").alias("is_merge"))
    parents = commits.select(F.col("hash").alias("parent"), F.col("author_date").alias("_pd"))
    return rows.join(parents, "parent").select(F.col("parent").alias("src"), F.col("hash").alias("dst"), log_gap(F.col("_pd"), F.col("author_date")).alias("log_days"), "is_merge")


def precedes(commits: DataFrame) -> DataFrame:
    """(src, dst, log_days): each commit to the next of its repository; undated ones come first and have no gap."""
    rows = _dated(commits.select("hash"), commits)
    following = F.lead(F.struct("hash", "author_date", "_known")).over(Window.partitionBy("repo_url").orderBy("author_date", "hash"))
    return rows.withColumn("next", following).where("next IS NOT NULL").select(F.col("hash").alias("src"), F.col("next.hash").alias("dst"), _gap().alias("log_days"))


def precedes_globally(commits: DataFrame) -> DataFrame:
    """The chain over all repositories, by global ranks: each rank joins the one after it."""
    ranked = with_global_rank(_dated(commits.select("hash"), commits).select("hash", "author_date", "_known"), [F.col("author_date"), F.col("hash")])
    after = ranked.select((F.col("rank") - 1).alias("rank"), F.struct("hash", "author_date", "_known").alias("next"))
    return ranked.join(after, "rank").select(F.col("hash").alias("src"), F.col("next.hash").alias("dst"), _gap().alias("log_days"))


def chain_candidates(mapping: DataFrame, known: DataFrame) -> DataFrame:
    """(cve_id, n_commits, n_new, resolvable): the fix and introducing commits of each entry; ``mapping``: cve_id, fc_hash, vcc_list; ``known``: hash."""
    every = mapping.select("cve_id", F.explode(F.array_append("vcc_list", F.col("fc_hash"))).alias("hash")).where("hash IS NOT NULL AND hash <> ''").distinct()
    marked = every.join(known.select("hash", F.lit(True).alias("_k")).distinct(), "hash", "left")
    return marked.groupBy("cve_id").agg(F.count("*").alias("n_commits"), F.count_if(F.col("_k").isNull()).alias("n_new"), (F.count_if(F.col("_k").isNull()) == 0).alias("resolvable"))


def clean_candidates(files: DataFrame, targets: DataFrame, chain: DataFrame) -> DataFrame:
    """(hash): commits that touch a target basename (``base``) and are in no chain (``hash``)."""
    touching = files.withColumn("base", basename(F.col("filename"))).join(targets.select("base"), "base", "left_semi")
    return touching.select("hash").distinct().join(chain.select("hash"), "hash", "left_anti")
