"""Exploratory statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as d
from .common import oracle, query, rs

_NUM = ["num_lines_changed", "num_files_changed", "dmm_unit_size", "dmm_unit_complexity"]
_MELT = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM fx_commit" for c in _NUM)
_BINS = "CASE WHEN h < -24 THEN '<-24h' WHEN h < -1 THEN '-24→-1h' WHEN h < 0 THEN '-1→0h' WHEN h < 1.0/60 THEN '0→1min' WHEN h < 1 THEN '1min→1h' WHEN h < 24 THEN '1→24h' WHEN h < 168 THEN '1→7d' WHEN h IS NOT NULL THEN '>7d' END"
_DELAYS = "SELECT commit_type, epoch(CAST(committer_date AS TIMESTAMP) - CAST(author_date AS TIMESTAMP)) / 3600 AS h FROM fx_commit WHERE committer_date IS NOT NULL AND author_date IS NOT NULL"
_COMPLETE = f"SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _NUM)} FROM fx_commit WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _NUM)}"
# Ties of means depend on the order of summation; rounding makes them ties on both engines.
_ROUNDED = f"SELECT {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _NUM)} FROM fx_commit WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _NUM)}"
_RANKED = "SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _NUM) + " FROM complete"
_HOURS = ", ".join(f"round(100.0 * count(*) FILTER (hour(ts) = {h}) / any_value(n), 6) AS h{h}" for h in range(24))


def _matrix(source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {source}" for a in _NUM for b in _NUM)


QUERIES = {
    "stat_missing_share": (
        query(lambda c: d.missing_share(c, [*_NUM, "committer_date", "author"]), "fx_commit"),
        oracle(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CAST({c} IS NULL AS INT)), 6) AS missing FROM fx_commit" for c in [*_NUM, "committer_date", "author"])),
    ),
    "stat_value_shares": (query(lambda c: d.value_shares(c, "commit_type"), "fx_commit"), oracle("SELECT commit_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM fx_commit GROUP BY 1")),
    "stat_top_repos": (query(lambda c: d.top_values(c, "repo_url", 10), "fx_commit"), oracle("SELECT repo_url AS value, count(*) AS n FROM fx_commit GROUP BY 1 ORDER BY n DESC, value LIMIT 10")),
    "stat_top_authors": (query(lambda c: d.top_values(c, "author", 10), "fx_commit"), oracle("SELECT author AS value, count(*) AS n FROM fx_commit GROUP BY 1 ORDER BY n DESC, value LIMIT 10")),
    "stat_distinct_counts": (
        query(lambda c: d.distinct_counts(c, ["hash", "repo_url", "author"]), "fx_commit"),
        oracle(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM fx_commit" for c in ("hash", "repo_url", "author"))),
    ),
    "stat_describe": (
        query(lambda c: d.describe(c, _NUM), "fx_commit"),
        oracle('SELECT "column", count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM m WHERE value IS NOT NULL GROUP BY 1', m=_MELT),
    ),
    "stat_describe_by_label": (
        query(lambda c: d.describe(c, ["num_lines_changed"], ["label"]), "fx_commit"),
        oracle('SELECT label, \'num_lines_changed\' AS "column", count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM (SELECT label, CAST(num_lines_changed AS DOUBLE) AS value FROM fx_commit) WHERE value IS NOT NULL GROUP BY 1'),
    ),
    "stat_yearly": (query(lambda c: d.yearly(c, "author_date"), "fx_commit"), oracle("SELECT year(author_date) AS year, count(*) AS n, strftime(min(author_date), '%Y-%m-%d') AS first, strftime(max(author_date), '%Y-%m-%d') AS last FROM fx_commit GROUP BY 1")),
    "stat_hour_shares": (query(lambda s: d.row_shares(s, "label", F.hour("ts").cast("long")), "fx_scores"), oracle("SELECT label, hour(ts) AS bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM fx_scores GROUP BY 1, 2")),
    "stat_weekday_shares": (query(lambda s: d.row_shares(s, "label", F.weekday("ts").cast("long")), "fx_scores"), oracle("SELECT label, isodow(ts) - 1 AS bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM fx_scores GROUP BY 1, 2")),
    "stat_weekday_hour_pivot": (
        query(lambda s: d.hour_pivot(s, "label", "ts"), "fx_scores"),
        oracle(f"SELECT label, weekday, {_HOURS} FROM (SELECT label, isodow(ts) - 1 AS weekday, ts, count(*) OVER (PARTITION BY label) AS n FROM fx_scores) GROUP BY 1, 2"),
    ),
    "stat_delay_crosstab": (
        query(lambda c: d.delay_crosstab(c, "commit_type", "author_date", "committer_date"), "fx_commit"),
        oracle(f"SELECT {_BINS} AS bin, commit_type AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY commit_type), 6) AS percent FROM delays GROUP BY 1, 2", delays=_DELAYS),
    ),
    "stat_median_delay": (query(lambda c: d.median_delay(c, "commit_type", "author_date", "committer_date"), "fx_commit"), oracle("SELECT commit_type AS label, round(median(h), 6) AS median_hours FROM delays GROUP BY 1", delays=_DELAYS)),
    "stat_pearson": (query(lambda c: d.pearson(c, _NUM), "fx_commit"), oracle(_matrix("complete"), complete=_COMPLETE)),
    "stat_spearman": (query(lambda c: d.spearman(c.select(*[F.round(F.col(x).cast("double"), 6).alias(x) for x in _NUM]), _NUM), "fx_commit"), oracle(_matrix("ranked"), complete=_ROUNDED, ranked=_RANKED)),
    "stat_mann_whitney": (
        query(lambda s: d.mann_whitney(s, "score", "label").select("u", "z"), "fx_scores"),
        oracle(
            "SELECT round(u, 6) AS u, round((u - n1 * n0 / 2) / sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM (SELECT sum(t) AS n, sum(ones) AS n1, sum(t - ones) AS n0, sum(t ** 3 - t) AS ties, sum(rank * ones) - sum(ones) * (sum(ones) + 1) / 2 AS u FROM by_value)",
            by_value="SELECT score, CAST(count(*) AS DOUBLE) AS t, CAST(sum(label) AS DOUBLE) AS ones, sum(count(*)) OVER (ORDER BY score) - (count(*) - 1) / 2.0 AS rank FROM fx_scores WHERE score IS NOT NULL GROUP BY score",
        ),
    ),
    "stat_flag_share": (query(lambda c: d.flag_share(c, F.coalesce(F.col("num_files_changed") > 3, F.lit(False)), "label"), "fx_commit"), oracle("SELECT label, round(avg(CASE WHEN num_files_changed > 3 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n FROM fx_commit GROUP BY 1")),
    "stat_box": (
        query(lambda c: d.box(c, "num_lines_changed", "commit_type"), "fx_commit"),
        oracle(f"SELECT label, {rs('q1', 'median', 'q3', 'min', 'max')}, round(greatest(min, q1 - 1.5 * (q3 - q1)), 6) AS low, round(least(max, q3 + 1.5 * (q3 - q1)), 6) AS high FROM q", q="SELECT commit_type AS label, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, min(v) AS min, max(v) AS max FROM (SELECT commit_type, CAST(num_lines_changed AS DOUBLE) AS v FROM fx_commit) GROUP BY 1"),
    ),
    "stat_vif_pair": (
        query(lambda c: d.variance_inflation(c, ["num_lines_changed", "dmm_unit_size"]), "fx_commit"),
        oracle("SELECT unnest(['num_lines_changed', 'dmm_unit_size']) AS \"column\", round(a * b / (a * b - ab * ab), 6) AS vif FROM (SELECT sum(num_lines_changed * num_lines_changed) AS a, sum(dmm_unit_size * dmm_unit_size) AS b, sum(num_lines_changed * dmm_unit_size) AS ab FROM fx_commit WHERE num_lines_changed IS NOT NULL AND dmm_unit_size IS NOT NULL)"),
    ),
    "stat_vif": (query(lambda c: d.variance_inflation(c, _NUM), "fx_commit"), None),
}
