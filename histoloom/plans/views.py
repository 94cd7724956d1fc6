"""The change-history tables as views over the shared test tables.

The same text runs on Spark SQL and DuckDB. ``{name}`` stands for another table or view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import dealt, written

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels"]

VIEWS = {
    "fx_commit": """
SELECT CAST(o.o_orderkey AS STRING) AS hash,
  CASE o.o_orderstatus WHEN 'F' THEN 'VCC' WHEN 'O' THEN 'FC' ELSE 'normal' END AS commit_type,
  CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
  n.n_name || '/' || c.c_mktsegment AS repo_url, o.o_orderdate AS author_date,
  CAST(o.o_custkey AS STRING) AS author, l.lines AS num_lines_changed, l.files AS num_files_changed,
  l.disc AS dmm_unit_size, l.tax AS dmm_unit_complexity, l.first_ship AS committer_date
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS lines, COUNT(DISTINCT l_partkey) AS files, AVG(l_discount) AS disc,
  AVG(l_tax) AS tax, MIN(l_shipdate) AS first_ship FROM {lineitem} GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""",
    "fx_file": """
SELECT CAST(l_orderkey AS STRING) AS hash, p_brand AS filename, SUM(l_quantity) AS num_lines_added,
  MAX(l_linenumber) AS num_lines_deleted, MAX(p_size) AS complexity,
  CASE MIN(l_returnflag) WHEN 'A' THEN 'ADD' WHEN 'N' THEN 'MODIFY' ELSE 'RENAME' END AS change_type
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand""",
    "fx_function": """
SELECT CAST(l_orderkey AS STRING) AS hash, p_brand AS filename, p_name AS name, MIN(l_linenumber) AS start_line,
  MAX(p_size) AS complexity, SUM(l_quantity) AS token_count, MAX(l_returnflag) = 'R' AS before_change
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand, p_name""",
    "fx_ownership": """
SELECT CAST(l_orderkey AS STRING) AS commit_hash, 'src/' || p_brand AS file_path,
  'dev' || CAST(l_suppkey AS STRING) AS dev_email,
  SUM(l_quantity) / SUM(SUM(l_quantity)) OVER (PARTITION BY l_orderkey, p_brand) AS ownership_ratio,
  SUM(l_quantity) AS lines_owned,
  SUM(SUM(l_quantity)) OVER (PARTITION BY l_orderkey, p_brand) AS total_lines, COUNT(*) AS edits_in_window,
  CASE l_orderkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 90 ELSE 180 END AS window_days
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand, l_suppkey""",
    "fx_commit_author": """
SELECT CAST(l_orderkey AS STRING) AS commit_hash, 'author' AS role, 'dev' || CAST(MIN(l_suppkey) AS STRING) AS dev_id
FROM {lineitem} GROUP BY l_orderkey UNION ALL
SELECT CAST(l_orderkey AS STRING), 'committer', 'dev' || CAST(MAX(l_suppkey) AS STRING) FROM {lineitem} GROUP BY l_orderkey""",
    "fx_commit_full": """
SELECT c.*, CAST(c.hash AS BIGINT) % 5 <> 0 AS in_main_branch, CAST(c.hash AS BIGINT) % 7 = 0 AS merge, CASE WHEN l.added IS NOT NULL THEN CAST(CAST(c.hash AS BIGINT) * 31 % 97 AS DOUBLE) / 97 END AS dmm_unit_interfacing,
  (CAST(c.hash AS BIGINT) % 25 - 12) * 3600 AS author_timezone, (CAST(c.hash AS BIGINT) % 13 - 6) * 1800 AS committer_timezone,
  CAST(c.author_date AS TIMESTAMP) + (CAST(c.hash AS BIGINT) % 1440) * INTERVAL '1' MINUTE AS authored_at,
  l.added AS num_lines_added, l.deleted AS num_lines_deleted, 'dev' || c.author AS committer
FROM {fx_commit} c LEFT JOIN (SELECT CAST(l_orderkey AS STRING) AS hash,
  SUM(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS added, SUM(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity END) AS deleted
  FROM {lineitem} GROUP BY l_orderkey) l ON l.hash = c.hash""",
    "fx_file_full": """
SELECT CAST(l_orderkey AS STRING) AS hash, p_brand AS filename, p_brand AS new_path, CASE WHEN MIN(l_returnflag) = 'R' THEN 'old/' || p_brand ELSE p_brand END AS old_path,
  CASE MIN(l_returnflag) WHEN 'A' THEN 'add' WHEN 'N' THEN 'MODIFY' ELSE 'RENAME' END AS change_type, SUM(l_quantity) AS num_lines_added, MAX(l_linenumber) AS num_lines_deleted,
  COUNT(*) AS num_method_changed, SUM(p_size) * 3 AS num_lines_of_code, MAX(p_size) AS complexity, SUM(l_quantity) * 2 AS token_count
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand""",
    "fx_function_full": """
SELECT CAST(l_orderkey AS STRING) AS hash, p_brand AS filename, p_name AS name, MIN(l_linenumber) AS start_line, MIN(l_linenumber) + MAX(p_size) AS end_line,
  SUM(p_size) AS num_lines_of_code, MAX(p_size) AS complexity, SUM(l_quantity) AS token_count, MAX(p_size) + 1 AS length, MIN(l_linenumber) % 4 AS top_nesting_level,
  MAX(l_returnflag) = 'R' AS before_change, COUNT(*) > 1 AS is_hunk, MAX(l_linenumber) % 5 AS n_parameters,
  CASE MIN(l_returnflag) WHEN 'A' THEN 'add ' WHEN 'N' THEN 'REFACTOR' ELSE 'RENAME' END AS function_change_type
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand, p_name""",
    "fx_process": """
SELECT hash, CASE WHEN k % 4 = 0 THEN 0.0 ELSE 1.0 END AS has_sdlc_data, k % 17 AS repo_commits_last_30d, k % 41 AS repo_commits_last_90d, k % 11 AS repo_active_authors_90d,
  k % 3 AS issue_open_30d, files AS issue_open_90d, files + k % 5 AS issue_open_180d, lines / 7 AS issue_age_median, k % 6 AS issues_closed_last_90d, k % 19 AS issues_closed_last_180d,
  CAST(k % 8 AS DOUBLE) / 30 AS issue_open_velocity_30d, CAST(k % 23 AS DOUBLE) / 90 AS issue_open_velocity_90d, k % 9 AS pr_count_30d, k % 13 AS pr_count_90d, k % 29 AS pr_count_180d, lines / 11 AS pr_age_median,
  k % 10 AS pr_closed_last_90d, k % 31 AS pr_closed_last_180d, CAST(k % 14 AS DOUBLE) / 30 AS pr_open_velocity_30d, CAST(k % 37 AS DOUBLE) / 90 AS pr_open_velocity_90d, k % 43 AS days_since_prev_tag, k % 4 AS tags_last_180d,
  k % 7 AS tags_last_365d, lines / 3 AS avg_release_cadence_days, CAST(k % 43 AS DOUBLE) / 43 AS days_since_prev_tag_norm, k % 997 AS dev_experience_days, k % 211 AS dev_commits_before, k % 2 AS dev_is_new_contributor,
  CAST(k % 15 AS DOUBLE) / 10 AS pr_to_issue_open_ratio_90d, CAST(k % 18 AS DOUBLE) / 10 AS issue_to_pr_closed_ratio_90d, k % 2 AS has_issue_pr_gap, k % 53 AS activity_since_last_tag,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 'v' || CAST(k % 5 AS STRING) || '.' || CAST(k % 2 AS STRING) || CASE WHEN k % 7 = 0 THEN '-rc1' ELSE '' END END AS prev_tag_name
FROM (SELECT hash, CAST(hash AS BIGINT) AS k, coalesce(CAST(num_files_changed AS DOUBLE), 0) AS files, coalesce(CAST(num_lines_changed AS DOUBLE), 0) AS lines FROM {fx_commit}) t""",
    "fx_issue": """
SELECT CAST(l_partkey AS STRING) AS issue_id, CAST(l_orderkey AS STRING) AS fc_hash, CAST(l_orderkey - l_orderkey % 2 AS STRING) AS vcc_hash, CAST(l_linenumber AS STRING) AS matched_anchor,
  CAST(MIN(p_retailprice) AS DOUBLE) AS votes, MIN(p_size) AS comments, CAST(MIN(l_shipdate) AS TIMESTAMP) AS created_at
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_orderkey, l_partkey, l_linenumber""",
    "fx_pull": """
SELECT CAST(l_suppkey AS STRING) AS pr_id, CAST(l_orderkey AS STRING) AS fc_hash, CAST(l_orderkey - l_orderkey % 2 AS STRING) AS vcc_hash, CAST(MIN(l_linenumber) AS STRING) AS matched_anchor,
  SUM(l_quantity) AS additions, CASE WHEN MIN(l_linenumber) % 2 = 0 THEN CAST(MIN(l_partkey) AS STRING) END AS linked_issue_id, 'closes #' || CAST(MAX(l_partkey) AS STRING) || ' and #0' AS title, CAST(MIN(l_shipdate) AS TIMESTAMP) AS created_at
FROM {lineitem} GROUP BY l_orderkey, l_suppkey""",
    "fx_developer": """
SELECT commit_hash, dev_email, SUM(lines_owned) AS repo_total_commits_before, COUNT(*) AS repo_active_weeks_before, MAX(total_lines) AS repo_tenure_days, SUM(edits_in_window) AS repo_commits_as_committer_before,
  MIN(lines_owned) AS recent_commits_90d, MIN(total_lines) AS time_since_last_commit_days, MAX(ownership_ratio) AS experience_percentile_in_repo, COUNT(DISTINCT file_path) AS cross_repo_commits_before,
  MAX(window_days) AS num_repos_contributed_before, SUM(total_lines) AS total_commits
FROM {fx_ownership} GROUP BY commit_hash, dev_email""",
    "fx_scores": """
SELECT event_id AS id, CAST(user_id AS STRING) AS grp, value / (value + 50) AS score,
  CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS label, ts FROM {events}""",
    "fx_runs": """
SELECT event_type AS run, user_id % 3 AS seed, DAY(ts) - 1 AS epoch, CASE WHEN user_id % 2 = 0 THEN 'val' ELSE 'train' END AS split,
  AVG(value) / 500 AS auc_pr, MAX(value) / 500 AS mcc FROM {events} GROUP BY 1, 2, 3, 4""",
}


#: How views put lines and parts together.
_LINES = "{lineitem} JOIN {part} ON l_partkey = p_partkey"


def _named(sql: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", sql))


def table(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A test table, or a view over them. ``given`` holds tables that are there already, under ``lines`` the lines with their parts."""
    given = given or {}
    if name in given:
        return given[name]
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace(_LINES, "{lines}") if "lines" in given else VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t, given) for t in _named(sql)})


def tables_by_commit(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """The views ``names``. Lines meet their parts once and lie by order, so that no view deals them again; commits and ownership, of which other
    views are made, lie by commit. Views marked ``_kept`` are written tables, or columns of one, and need not be written again."""
    needed = set(names)
    for v in reversed(VIEWS):  # views stand after those that they name
        if v in needed:
            needed |= _named(VIEWS[v])
    given = _lines(spark, sf_dir, " ".join(VIEWS[v] for v in needed if v in VIEWS))
    for name, key in (("fx_commit", "hash"), ("fx_ownership", "commit_hash")):
        if name in needed:
            given[name] = _kept(written(dealt(table(spark, sf_dir, name, given), key), name))
    out = {name: table(spark, sf_dir, name, given) for name in names}
    if "fx_process" in out:
        _kept(out["fx_process"])
    return out


def _kept(df: DataFrame) -> DataFrame:
    df._kept = True
    return df


def _lines(spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
    """The columns of lines and parts that ``text`` names: the lines with each of their parts, and the lines, over one written table."""
    if "{lineitem}" not in text:
        return {}
    columns = lambda first: sorted(set(re.findall(rf"\b{first}_\w+", text)))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *[c for c in columns("l") if c != "l_orderkey"])
    if _LINES not in text:
        return {"lineitem": written(dealt(lines, "l_orderkey"), "lines")}
    place = F.row_number().over(Window.partitionBy("p_partkey").orderBy("p_partkey"))
    parts = table(spark, sf_dir, "part").select(*columns("p")).withColumn("_place", place)
    both = written(dealt(lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left"), "l_orderkey"), "lines")
    return {"lines": both.where("_place IS NOT NULL").drop("_place"), "lineitem": both.where("_place IS NULL OR _place = 1").select(lines.columns)}


def oracle(body: str, **more: str) -> str:
    """DuckDB SQL: ``body`` after the views that it names and the CTEs in ``more``, in order."""
    text = " ".join([body, *more.values()])
    for v in reversed(VIEWS):  # views stand after those that they name
        if re.search(rf"\b{v}\b", text):
            text += VIEWS[v]
    parts = [f"{v} AS ({re.sub(r'{(\w+)}', r'\1', sql)})" for v, sql in VIEWS.items() if re.search(rf"\b{v}\b", text)]
    parts += [f"{name} AS ({sql})" for name, sql in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
