"""Split and fold queries. The test tables' repositories are named NATION/SEGMENT."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as p
from .common import oracle, query

_VAL, _TEST = ["NATION_3/", "NATION_7/"], ["NATION_11/", "NATION_15/", "NATION_20/"]
_LIKE = lambda names: " OR ".join(f"repo_url LIKE '%{n.replace('_', chr(92) + '_')}%' ESCAPE '{chr(92)}'" for n in names)
_CLASS = f"CASE WHEN {_LIKE(_TEST)} THEN 'test' WHEN {_LIKE(_VAL)} THEN 'val' ELSE 'train' END"
_CUT = "CASE WHEN rank <= floor(total * 0.7) THEN 'train' WHEN rank <= floor(total * 0.85) THEN 'val' ELSE '{}' END"
_DATED = "SELECT *, row_number() OVER (ORDER BY author_date, hash) AS rank, count(*) OVER () AS total FROM {} WHERE author_date IS NOT NULL"
_CWE_EXPR = "CASE WHEN label = 1 THEN 'CWE-' || CAST(CAST(author AS INT) % 200 AS STRING) || ', CWE-' || CAST(CAST(hash AS INT) % 130 AS STRING) ELSE '' END"
_CWE = f"SELECT *, {_CWE_EXPR} AS cwe_id FROM fx_commit"
_PLAIN = ["hash", "label", "repo_url", "repo_split"]
_HN = "num_lines_changed", "num_files_changed", "dmm_unit_size", "dmm_unit_complexity"
_HN_SQL = "(" + " + ".join(f"{w} * coalesce({c}, 0) / max(coalesce({c}, 0)) OVER ()" for c, w in p.HARDNESS.items() if c in _HN) + f") / {sum(w for c, w in p.HARDNESS.items() if c in _HN)}"


def _identity(source: str, columns: str) -> dict[str, str]:
    return {
        "owners": source,
        "ids": f"SELECT {columns}, row_number() OVER (ORDER BY md5('42' || {columns.replace(', ', ' || ')}), {columns}) AS rank, count(*) OVER () AS total FROM (SELECT DISTINCT {columns} FROM owners)",
        "worst": f"SELECT hash, max(CASE WHEN rank <= floor(total * (1 - 0.3)) THEN 0 WHEN rank <= floor(total * 0.85) THEN 1 ELSE 2 END) AS level FROM owners JOIN ids USING ({columns}) GROUP BY 1",
    }


def _by_level(source: str = "fx_commit") -> str:
    return f"SELECT hash, label, repo_url, CASE level WHEN 2 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS repo_split FROM {source} LEFT JOIN worst USING (hash)"


def _plain(fn):
    return lambda *frames: fn(*frames).select(*_PLAIN)


_DEV = "SELECT commit_hash AS hash, dev_id FROM fx_commit_author"
_SEV = f"""SELECT hash, label, repo_url, CASE WHEN label = 1 AND sev >= 2 THEN 'test' WHEN label = 1 AND sev = 1 THEN 'val' ELSE 'train' END AS repo_split FROM cwe LEFT JOIN
(SELECT hash, max(CASE WHEN c IN ({str(p.CRITICAL)[1:-1]}) THEN 3 WHEN c IN ({str(p.HIGH)[1:-1]}) THEN 2 WHEN c IN ({str(p.LOW)[1:-1]}) THEN 0 ELSE 1 END) AS sev FROM (SELECT hash, trim(unnest(string_split(cwe_id, ','))) AS c FROM cwe) WHERE c <> '' GROUP BY 1) USING (hash)"""

QUERIES = {
    "split_repo": (query(_plain(lambda c: p.by_repo(c, _VAL, _TEST)), "fx_commit"), oracle(f"SELECT hash, label, repo_url, {_CLASS} AS repo_split FROM fx_commit")),
    "split_temporal": (query(_plain(p.by_time), "fx_commit"), oracle(f"SELECT hash, label, repo_url, {_CUT.format('test')} AS repo_split FROM ranked", ranked=_DATED.format("fx_commit"))),
    "split_repo_temporal": (
        query(_plain(lambda c: p.by_repo_and_time(c, val_repos=_VAL, test_repos=_TEST)), "fx_commit"),
        oracle(
            f"SELECT hash, label, repo_url, s AS repo_split FROM (SELECT *, {_CUT.format('out')} AS s FROM ranked) WHERE s <> 'out' UNION ALL SELECT hash, label, repo_url, c FROM classed WHERE c <> 'train'",
            classed=f"SELECT *, {_CLASS} AS c FROM fx_commit", pool="SELECT * FROM classed WHERE c = 'train'", ranked=_DATED.format("pool"),
        ),
    ),
    "split_developer": (query(_plain(lambda c, a: p.by_identity(c, a.select(F.col("commit_hash").alias("hash"), "dev_id"), ["dev_id"])), "fx_commit", "fx_commit_author"), oracle(_by_level(), **_identity(_DEV, "dev_id"))),
    "split_file": (query(_plain(lambda c, f: p.by_identity(c, f, ["filename"])), "fx_commit", "fx_file"), oracle(_by_level(), **_identity("SELECT hash, filename FROM fx_file", "filename"))),
    "split_function": (query(_plain(lambda c, f: p.by_identity(c, f, ["name", "filename"])), "fx_commit", "fx_function"), oracle(_by_level(), **_identity("SELECT hash, name, filename FROM fx_function", "name, filename"))),
    "split_weakness": (
        query(_plain(lambda c: p.by_weakness(c.withColumn("cwe_id", F.expr(_CWE_EXPR)))), "fx_commit"),
        oracle(_by_level("cwe"), cwe=_CWE, **{k: v.replace("(1 - 0.3)", "(1 - 0.2 - 0.15)").replace("total * 0.85", "total * (1 - 0.2 - 0.15 + 0.15)") for k, v in _identity("SELECT DISTINCT hash, cwe FROM (SELECT hash, trim(unnest(string_split(cwe_id, ','))) AS cwe FROM cwe WHERE label = 1) WHERE cwe <> ''", "cwe").items()}),
    ),
    "split_severity": (query(_plain(lambda c: p.by_severity(c.withColumn("cwe_id", F.expr(_CWE_EXPR)))), "fx_commit"), oracle(_SEV, cwe=_CWE)),
    "split_hard_negatives": (
        query(lambda c: p.by_hard_negatives(c, val_repos=_VAL, test_repos=_TEST, places=6).select(*_PLAIN, "hn_score"), "fx_commit"),
        oracle(
            f"SELECT hash, label, repo_url, CASE WHEN label = 1 THEN {_CLASS} WHEN rank <= floor(total * 0.2) THEN 'test' ELSE 'train' END AS repo_split, round(hn_score, 6) AS hn_score FROM ranked",
            scored=f"SELECT *, {_HN_SQL} AS hn_score FROM fx_commit", ranked="SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(hn_score, 6) DESC, hash) AS rank, count(*) OVER (PARTITION BY label) AS total FROM scored",
        ),
    ),
    "split_graph_size": (
        query(lambda c: p.by_graph_size(c).select(*_PLAIN, "graph_score"), "fx_commit"),
        oracle(
            "SELECT hash, label, repo_url, CASE WHEN rank / total <= 0.5 THEN 'train' WHEN rank / total <= 0.75 THEN 'val' ELSE 'test' END AS repo_split, graph_score FROM ranked",
            ranked="SELECT *, row_number() OVER (ORDER BY graph_score, hash) AS rank, count(*) OVER () AS total FROM (SELECT *, CAST(coalesce(num_lines_changed, 0) + coalesce(num_files_changed, 0) AS DOUBLE) AS graph_score FROM fx_commit)",
        ),
    ),
    "split_cold_start": (
        query(_plain(lambda c: p.cold_start(c, 5, 40, _VAL, _TEST)), "fx_commit"),
        oracle(
            "SELECT hash, label, repo_url, CASE WHEN early.hash IS NOT NULL THEN 'train' WHEN cold.repo_url IS NOT NULL THEN 'test' ELSE c END AS repo_split FROM classed LEFT JOIN cold USING (repo_url) LEFT JOIN early USING (hash)",
            classed=f"SELECT *, {_CLASS} AS c FROM fx_commit", cold="SELECT repo_url FROM classed WHERE c = 'train' GROUP BY 1 ORDER BY count(*), repo_url LIMIT 5", early="SELECT hash FROM classed JOIN cold USING (repo_url) ORDER BY author_date, hash LIMIT 40",
        ),
    ),
    "fold_repo_grouped": (
        query(lambda c: p.repo_folds(c, 5).select("hash", "repo_url", "fold"), "fx_commit"),
        oracle(
            "SELECT hash, repo_url, fold FROM fx_commit JOIN dealt USING (repo_url)",
            sizes="SELECT repo_url, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, repo_url) AS rn FROM fx_commit GROUP BY 1",
            steps="SELECT * FROM (WITH RECURSIVE s(rn, loads, fold) AS (SELECT CAST(0 AS BIGINT), CAST([0, 0, 0, 0, 0] AS BIGINT[]), CAST(NULL AS BIGINT) UNION ALL SELECT z.rn, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + z.n ELSE x END), CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT) FROM s JOIN sizes z ON z.rn = s.rn + 1) SELECT rn, fold FROM s)",
            dealt="SELECT repo_url, fold FROM sizes JOIN steps USING (rn)",
        ),
    ),
    "split_repo_first": (query(_plain(lambda c: p.by_repo_first(c.withColumn("repo_url", F.when(F.col("label") == 1, F.concat(F.lit("https://x/"), F.when(F.col("num_files_changed") > 3, "gpac/gpac").otherwise("krb5/krb5"))).otherwise(F.col("repo_url"))))), "fx_commit"), oracle("SELECT hash, label, CASE WHEN label = 1 THEN 'https://x/' || CASE WHEN num_files_changed > 3 THEN 'gpac/gpac' ELSE 'krb5/krb5' END ELSE repo_url END AS repo_url, CASE WHEN label = 0 THEN 'train' WHEN num_files_changed > 3 THEN 'val' ELSE 'test' END AS repo_split FROM fx_commit")),
    "fold_leave_one_repo_out": (
        query(lambda c: p.leave_one_repo_out(c, 3).select("hash", "fold", "part"), "fx_commit"),
        oracle("SELECT hash, fold, CASE WHEN c.repo_url = f.repo_url THEN 'val' ELSE 'train' END AS part FROM fx_commit c, folds f", folds="SELECT repo_url, row_number() OVER (ORDER BY count(*) DESC, repo_url) - 1 AS fold FROM fx_commit GROUP BY 1 ORDER BY count(*) DESC, repo_url LIMIT 3"),
    ),
    "fold_walk_forward": (
        query(lambda c: p.walk_forward(c, 4), "fx_commit"),
        oracle("SELECT hash, chunk, fold, CASE WHEN chunk = fold + 4 THEN 'val' ELSE 'train' END AS part FROM (SELECT hash, least((rank - 1) * 8 // total, 7) AS chunk FROM ranked), range(4) r(fold) WHERE chunk <= fold + 4", ranked=_DATED.format("fx_commit")),
    ),
    "fold_expanding": (
        query(lambda c: p.expanding_folds(c, 5), "fx_commit"),
        oracle("SELECT hash, fold, CASE WHEN rank <= total - (5 - fold) * (total // 6) THEN 'train' ELSE 'val' END AS part FROM ranked, range(5) r(fold) WHERE rank <= total - (4 - fold) * (total // 6)", ranked=_DATED.format("fx_commit")),
    ),
    "split_stratified_holdout": (
        query(_plain(p.stratified_holdout), "fx_commit"),
        oracle("SELECT hash, label, repo_url, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42' || hash), hash) <= floor(count(*) OVER (PARTITION BY label) * 0.2) THEN 'test' ELSE 'train' END AS repo_split FROM fx_commit"),
    ),
    "split_time_holdout": (query(_plain(p.time_holdout), "fx_commit"), oracle("SELECT hash, label, repo_url, CASE WHEN rank <= floor(total * 0.8) THEN 'train' ELSE 'test' END AS repo_split FROM ranked", ranked=_DATED.format("fx_commit"))),
    "split_enriched": (
        query(lambda c, f: p.enriched(c.select("hash", "label"), c.select("hash", "dmm_unit_size", "author"), f.groupBy("hash").agg(F.count("*").alias("n_files"))).na.fill(0, ["n_files"]), "fx_commit", "fx_file"),
        oracle("SELECT hash, label, round(dmm_unit_size, 6) AS dmm_unit_size, author, coalesce(n_files, 0) AS n_files FROM fx_commit LEFT JOIN (SELECT hash, count(*) AS n_files FROM fx_file GROUP BY 1) USING (hash)"),
    ),
    "weight_classes": (
        query(lambda c: p.class_weights(c).select("hash", "class_weight", "repo_weight"), "fx_commit"),
        oracle("SELECT hash, round(count(*) OVER () / (2 * count(*) OVER (PARTITION BY label)), 6) AS class_weight, round(1 / ((SELECT count(DISTINCT repo_url) FROM fx_commit) * count(*) OVER (PARTITION BY repo_url, label)), 6) AS repo_weight FROM fx_commit"),
    ),
    "weight_label_ratio": (query(p.label_ratio, "fx_commit"), oracle("SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, round(count(*) FILTER (label = 0) / count(*) FILTER (label = 1), 6) AS neg_pos_ratio FROM fx_commit")),
    "weight_resample": (
        query(lambda c: p.weighted_resample(c.withColumn("w", F.col("num_files_changed").cast("double")), "w", c.count()), "fx_commit"),
        oracle(
            "SELECT draw, hash FROM (SELECT i AS draw, CAST(('0x' || substr(md5('42|' || CAST(i AS STRING)), 1, 13)) AS BIGINT) / 4503599627370496.0 * (SELECT max(top) FROM spans) AS x FROM range((SELECT count(*) FROM fx_commit)) r(i)) d ASOF JOIN spans s ON d.x < s.top",
            spans="SELECT hash, CAST(sum(num_files_changed) OVER (ORDER BY hash) AS DOUBLE) AS top FROM fx_commit WHERE num_files_changed > 0",
        ),
    ),
}
