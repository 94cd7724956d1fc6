"""Split, feature and coverage audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as v
from ..operators import splits as p
from .common import oracle, query
from .splits import _CLASS, _CUT, _DATED, _TEST, _VAL

_TIME = f"SELECT r.*, {_CUT.format('test')} AS repo_split FROM ranked r"
_REPO = f"SELECT *, {_CLASS} AS repo_split FROM fx_commit"
_BOTH = {"ranked": _DATED.format("fx_commit"), "split": _TIME}
_NUM = ["num_lines_changed", "num_files_changed", "dmm_unit_size", "dmm_unit_complexity"]
_LONG = " UNION ALL ".join(f"SELECT repo_split, label, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM split WHERE {c} IS NOT NULL" for c in _NUM)
_DAY = "strftime({}(author_date), '%Y-%m-%d')"


def _time(fn):
    return lambda c, *more: fn(p.by_time(c), *more)


def _repo(fn):
    return lambda c, *more: fn(p.by_repo(c, _VAL, _TEST), *more)


def _rounded(c):
    return c.select("*", *[F.round(F.col(x).cast("double"), 6).alias(f"r_{x}") for x in _NUM]).drop(*_NUM).withColumnsRenamed({f"r_{x}": x for x in _NUM})


def _findings(c):
    rows = None
    for name, split in (("temporal", p.by_time(c)), ("repo", p.by_repo(c, _VAL, _TEST))):
        repos = v.overlap(split, "repo_url").agg(F.count("*").alias("n")).select(F.lit(name).alias("strategy"), F.lit("repo_overlap").alias("finding"), "n")
        future = v.future_leak(split).select(F.lit(name).alias("strategy"), F.lit("future_leak").alias("finding"), F.col("n_future").alias("n"))
        part = repos.unionByName(future)
        rows = part if rows is None else rows.unionByName(part)
    return v.verdicts(rows)


QUERIES = {
    "audit_split_summary": (
        query(_time(v.split_summary), "fx_commit"),
        oracle(f"SELECT repo_split, count(*) AS n, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, round(avg(label), 6) AS pos_ratio, count(DISTINCT repo_url) AS n_repos, {_DAY.format('min')} AS first, {_DAY.format('max')} AS last FROM split GROUP BY 1", **_BOTH),
    ),
    "audit_several_splits": (
        query(lambda c: v.in_several_splits(p.by_time(c).select("hash", "repo_split").union(p.by_repo(c, _VAL, _TEST).select("hash", "repo_split"))), "fx_commit"),
        oracle("SELECT hash, count(DISTINCT repo_split) AS n_splits FROM (SELECT hash, repo_split FROM split UNION ALL SELECT hash, repo_split FROM other) GROUP BY 1 HAVING count(DISTINCT repo_split) > 1", other=_REPO, **_BOTH),
    ),
    "audit_repo_overlap": (query(_time(lambda s: v.overlap(s, "repo_url")), "fx_commit"), oracle("SELECT repo_url FROM split WHERE repo_split = 'train' INTERSECT SELECT repo_url FROM split WHERE repo_split = 'test'", **_BOTH)),
    "audit_pair_overlaps": (
        query(_time(lambda s: v.pair_overlaps(s, "author")), "fx_commit"),
        oracle("SELECT a.repo_split AS a, b.repo_split AS b, count(*) AS n FROM (SELECT DISTINCT repo_split, author FROM split) a JOIN (SELECT DISTINCT repo_split, author FROM split) b USING (author) WHERE a.repo_split < b.repo_split GROUP BY 1, 2", **_BOTH),
    ),
    "audit_future_leak": (
        query(_repo(v.future_leak), "fx_commit"),
        oracle("SELECT count(*) AS n_train, count(*) FILTER (late) AS n_future, round(avg(CAST(late AS INT)), 6) AS share FROM (SELECT author_date > (SELECT min(author_date) FROM split WHERE repo_split = 'test') AS late FROM split WHERE repo_split = 'train')", split=_REPO),
    ),
    "audit_split_problems": (
        query(lambda c: v.split_problems(p.by_repo(c, _VAL, _TEST).where("NOT (repo_split = 'val' AND label = 1)").withColumn("repo_split", F.when(F.col("repo_split") == "test", "tests").otherwise(F.col("repo_split")))), "fx_commit"),
        oracle("SELECT 'empty' AS problem, 'test' AS part UNION ALL SELECT 'no_positives', 'val' WHERE EXISTS (SELECT 1 FROM split WHERE repo_split = 'val' AND label = 0) UNION ALL SELECT 'unknown', 'tests' WHERE EXISTS (SELECT 1 FROM split WHERE repo_split = 'test')", split=_REPO),
    ),
    "audit_verdicts": (
        query(_findings, "fx_commit"),
        oracle(
            """SELECT strategy, finding, n, CASE WHEN n = 0 THEN 'PASS' WHEN (finding = 'repo_overlap' AND strategy = 'temporal') OR (finding = 'future_leak' AND strategy = 'repo') THEN 'BY-DESIGN' ELSE 'FAIL' END AS status FROM (
SELECT s.strategy, 'repo_overlap' AS finding, (SELECT count(*) FROM (SELECT repo_url FROM every e WHERE e.strategy = s.strategy GROUP BY 1 HAVING bool_or(repo_split = 'train') AND bool_or(repo_split = 'test'))) AS n FROM firsts s
UNION ALL SELECT s.strategy, 'future_leak', (SELECT count(*) FROM every e WHERE e.strategy = s.strategy AND repo_split = 'train' AND author_date > s.first) FROM firsts s)""",
            ranked=_DATED.format("fx_commit"), every=f"SELECT 'temporal' AS strategy, repo_split, repo_url, author_date FROM ({_TIME}) UNION ALL SELECT 'repo', repo_split, repo_url, author_date FROM ({_REPO})",
            firsts="SELECT strategy, min(author_date) AS first FROM every WHERE repo_split = 'test' GROUP BY 1",
        ),
    ),
    "audit_label_conflicts": (
        query(lambda c, s: v.label_conflicts(s.select(F.col("grp").alias("hash"), "label")), "fx_commit", "fx_scores"),
        oracle("SELECT grp AS hash, count(DISTINCT label) AS n_labels, count(*) AS n_rows FROM fx_scores GROUP BY 1 HAVING count(DISTINCT label) > 1 OR count(*) > 1"),
    ),
    "audit_time_bounds": (
        query(_repo(v.time_bounds), "fx_commit"),
        oracle(f"SELECT repo_split, {_DAY.format('min')} AS first, {_DAY.format('max')} AS last, count(*) AS n, count(*) FILTER (author_date < (SELECT max(author_date) FROM split WHERE repo_split = 'train')) AS n_before_train_end FROM split GROUP BY 1", split=_REPO),
    ),
    "audit_expected_repos": (
        query(_repo(lambda s: v.expected_difference(s.select("repo_url").where("repo_url LIKE '%BUILDING'").distinct(), s.where("repo_split = 'test'").select("repo_url").distinct())), "fx_commit"),
        oracle("SELECT repo_url AS value, 'missing' AS problem FROM (SELECT repo_url FROM split WHERE repo_url LIKE '%BUILDING' EXCEPT SELECT repo_url FROM split WHERE repo_split = 'test') UNION ALL SELECT repo_url, 'unexpected' FROM (SELECT repo_url FROM split WHERE repo_split = 'test' EXCEPT SELECT repo_url FROM split WHERE repo_url LIKE '%BUILDING')", split=_REPO),
    ),
    "audit_scaler_leaks": (
        query(lambda c: v.scaler_leaks(c.groupBy("repo_url").count().where("count >= 10"), p.by_repo(c, _VAL, _TEST)), "fx_commit"),
        oracle("SELECT repo_url, string_agg(DISTINCT repo_split, ',') AS parts FROM split WHERE repo_url IN (SELECT repo_url FROM fx_commit GROUP BY 1 HAVING count(*) >= 10) GROUP BY 1 HAVING string_agg(DISTINCT repo_split, ',') <> 'train'", split=_REPO),
    ),
    "audit_feature_auc": (
        query(lambda c: v.feature_auc(p.by_repo(_rounded(c), _VAL, _TEST), _NUM), "fx_commit"),
        oracle(
            'SELECT scope, "column", round(greatest(a, 1 - a), 6) AS auc, greatest(a, 1 - a) > 0.7 AS flagged FROM (SELECT scope, "column", CASE WHEN sum(ones) > 0 AND sum(t - ones) > 0 THEN (sum(rank * ones) - sum(ones) * (sum(ones) + 1) / 2) / (sum(ones) * sum(t - ones)) ELSE 0.5 END AS a FROM ranked GROUP BY 1, 2)',
            split=_REPO, long=_LONG.replace("CAST(", "round(CAST(").replace("DOUBLE)", "DOUBLE), 6)"),
            counts='SELECT coalesce(repo_split, \'all\') AS scope, "column", value, count(*) AS t, sum(label) AS ones FROM long GROUP BY GROUPING SETS ((repo_split, "column", value), ("column", value))',
            ranked='SELECT *, sum(t) OVER (PARTITION BY scope, "column" ORDER BY value) - (t - 1) / 2.0 AS rank FROM counts',
        ),
    ),
    "audit_column_profile": (
        query(lambda c: v.column_profile(c, _NUM), "fx_commit"),
        oracle('SELECT "column", round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(avg(CAST(value = 0 AS INT)), 6) AS zero_share FROM long GROUP BY 1', split="SELECT *, '' AS repo_split FROM fx_commit", long=_LONG),
    ),
    "audit_domain": (
        query(lambda c: v.domain_problems(c, ["label", "num_files_changed"], {"dmm_unit_size": (0, 0.05), "dmm_unit_complexity": (0, 1)}), "fx_commit"),
        oracle("SELECT 'binary' AS \"check\", 'label' AS \"column\", count(*) FILTER (label NOT IN (0, 1)) AS n_bad FROM fx_commit UNION ALL SELECT 'binary', 'num_files_changed', count(*) FILTER (num_files_changed NOT IN (0, 1)) FROM fx_commit UNION ALL SELECT 'range', 'dmm_unit_size', count(*) FILTER (dmm_unit_size < -1e-5 OR dmm_unit_size > 0.05001) FROM fx_commit UNION ALL SELECT 'range', 'dmm_unit_complexity', count(*) FILTER (dmm_unit_complexity < -1e-5 OR dmm_unit_complexity > 1.00001) FROM fx_commit"),
    ),
    "audit_norms": (
        query(lambda e: v.norms(e, "embedding"), "embeddings"),
        oracle("SELECT count(*) AS n_rows, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, round(avg(n), 6) AS mean_norm, round(avg(CAST(n = 0 AS INT)), 6) AS zero_share FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)"),
    ),
    "audit_coverage": (
        query(lambda c, f, w: v.coverage(c, file=f, ownership=w), "fx_commit", "fx_file", "fx_ownership"),
        oracle("SELECT commit_type, label, f.hash IS NOT NULL AS has_file, w.hash IS NOT NULL AS has_ownership, f.hash IS NOT NULL OR w.hash IS NOT NULL AS has_any, count(*) AS n FROM fx_commit LEFT JOIN (SELECT DISTINCT hash FROM fx_file) f USING (hash) LEFT JOIN (SELECT DISTINCT commit_hash AS hash FROM fx_ownership) w USING (hash) GROUP BY ALL"),
    ),
    "audit_orphan_keys": (
        query(lambda w, a: v.orphan_keys(w, a, "dev_email", "dev_id"), "fx_ownership", "fx_commit_author"),
        oracle("SELECT DISTINCT dev_email AS key FROM fx_ownership WHERE dev_email NOT IN (SELECT dev_id FROM fx_commit_author)"),
    ),
    "audit_stratified_sample": (
        query(lambda c: v.stratified_sample(c, 50).select("hash", "label"), "fx_commit"),
        oracle("SELECT hash, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42' || hash), hash) AS rn FROM fx_commit) WHERE rn <= 50"),
    ),
    "audit_integration": (
        query(lambda f, w: v.integration(f.groupBy("hash").agg(F.count("*").alias("files")), w.groupBy(F.col("commit_hash").alias("hash")).agg(F.count_distinct("file_path").alias("files"))), "fx_file", "fx_ownership"),
        oracle("SELECT hash, 'files' AS errors FROM (SELECT hash, count(*) AS a FROM fx_file GROUP BY 1) FULL JOIN (SELECT commit_hash AS hash, count(DISTINCT file_path) AS b FROM fx_ownership GROUP BY 1) USING (hash) WHERE coalesce(a, 0) <> coalesce(b, 0)"),
    ),
    "audit_misaligned": (
        query(lambda f, fn: v.misaligned(f.selectExpr("hash AS pos", "min(filename) OVER (PARTITION BY hash) AS k").distinct(), fn.groupBy(F.col("hash").alias("pos")).agg(F.max("filename").alias("k")), "pos", ["k"]).select(F.col("_pos").alias("pos"), "a_k", "b_k"), "fx_file", "fx_function"),
        oracle("SELECT pos, a_k, b_k FROM (SELECT hash AS pos, min(filename) AS a_k FROM fx_file GROUP BY 1) FULL JOIN (SELECT hash AS pos, max(filename) AS b_k FROM fx_function GROUP BY 1) USING (pos) WHERE a_k IS DISTINCT FROM b_k"),
    ),
}
