"""Queries on the graph across commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as x
from ..operators import nodes as n
from .common import oracle, query

_SIGNED = "sign({0}) * ln(1 + abs({0}))"
_GAP = "ln(1 + floor(epoch(CAST({} AS TIMESTAMP) - CAST({} AS TIMESTAMP)) / 86400))"
_FILES = "SELECT f.*, c.repo_url, c.author_date, lead({'h': f.hash, 'd': c.author_date, 'c': complexity, 'l': num_lines_of_code, 't': token_count}) OVER (PARTITION BY c.repo_url, filename ORDER BY coalesce(c.author_date, DATE '1970-01-01'), f.hash) AS nx FROM fx_file_full f JOIN dated c ON c.hash = f.hash"
_FNS = "SELECT f.*, c.repo_url, c.author_date, lead({'h': f.hash, 'd': c.author_date, 'f': filename, 'c': complexity, 'l': num_lines_of_code}) OVER (PARTITION BY c.repo_url, name ORDER BY coalesce(c.author_date, DATE '1970-01-01'), f.hash, filename) AS nx FROM fx_function_full f JOIN dated c ON c.hash = f.hash"
# A seventh of the commits has no date here.
_DATED = "SELECT * REPLACE (CASE WHEN CAST(hash AS BIGINT) % 7 = 0 THEN NULL ELSE author_date END AS author_date) FROM fx_commit"
_ALL_DATED = "SELECT * FROM fx_commit"
_EVO = f"SELECT filename, hash AS src, nx.h AS dst, round({_SIGNED.format('(nx.c - complexity)')}, 6) AS d_complexity, round({_SIGNED.format('(nx.l - num_lines_of_code)')}, 6) AS d_lines, round({_SIGNED.format('(nx.t - token_count)')}, 6) AS d_tokens, round(coalesce({_GAP.format('nx.d', 'author_date')}, 0), 6) AS gap FROM files WHERE nx IS NOT NULL AND nx.h <> hash"


def _undated(c):
    return c.withColumn("author_date", F.when(F.col("hash").cast("long") % 7 != 0, F.col("author_date")))


# A vcc commit's fix: the next commit of its author that is one.
_PAIRS = "SELECT v.hash AS vcc_hash, min(f.hash) AS fc_hash FROM fx_commit v JOIN fx_commit f ON f.author = v.author AND f.repo_url = v.repo_url WHERE v.commit_type = 'VCC' AND f.commit_type = 'FC' GROUP BY 1"


def _pairs(c):
    v = c.where("commit_type = 'VCC'").select(F.col("hash").alias("vcc_hash"), "author", "repo_url")
    f = c.where("commit_type = 'FC'").select(F.col("hash").alias("fc_hash"), "author", "repo_url")
    return v.join(f, ["author", "repo_url"]).groupBy("vcc_hash").agg(F.min("fc_hash").alias("fc_hash"))


def _renamed(f):
    return f.withColumn("function_change_type", F.when(F.col("complexity") > 20, "RENAME").otherwise("MODIFY"))


_PARENTS = "SELECT *, list_filter([CAST(CAST(hash AS BIGINT) - 1 AS STRING), CAST(CAST(hash AS BIGINT) // 2 AS STRING)], lambda p: CAST(p AS BIGINT) % 3 <> 0) AS parent_list FROM fx_commit"


def _with_parents(c):
    h = F.col("hash").cast("long")
    listed = F.array((h - 1).cast("string"), F.expr("cast(hash as bigint) div 2").cast("string"))
    return c.withColumn("parent_list", F.filter(listed, lambda p: p.cast("long") % 3 != 0))


QUERIES = {
    "history_repo_commits": (query(lambda c: x.repo_commits(c, "NATION_3/BUILDING").select("hash", "commit_type"), "fx_commit"), oracle("SELECT hash, commit_type FROM fx_commit WHERE repo_url = 'NATION_3/BUILDING'")),
    "history_file_evolution": (query(lambda f, c: x.file_evolution(f, _undated(c)), "fx_file_full", "fx_commit"), oracle(_EVO, dated=_DATED, files=_FILES)),
    "history_file_evolution_global": (query(lambda f, c: x.file_evolution(f, _undated(c), False), "fx_file_full", "fx_commit"), oracle(_EVO, dated=_DATED, files=_FILES.replace("PARTITION BY c.repo_url, filename", "PARTITION BY filename"))),
    "history_function_evolution": (
        query(lambda f, c: x.function_evolution(f, _undated(c)).withColumn("kind", F.array_join("kind", "")), "fx_function_full", "fx_commit"),
        oracle(
            f"SELECT name, hash AS src, filename AS src_file, nx.h AS dst, nx.f AS dst_file, CASE trim(function_change_type) WHEN 'add' THEN '0.01.00.00.00.0' WHEN 'RENAME' THEN '0.00.00.01.00.0' ELSE '0.00.00.00.01.0' END AS kind, round({_SIGNED.format('(nx.c - complexity)')}, 6) AS d_complexity, round({_SIGNED.format('(nx.l - num_lines_of_code)')}, 6) AS d_lines, round(coalesce({_GAP.format('nx.d', 'author_date')}, 0), 6) AS gap FROM fns WHERE nx IS NOT NULL AND nx.h <> hash",
            dated=_DATED, fns=_FNS,
        ),
    ),
    "history_file_renames": (
        query(lambda f, c: x.file_renames(f, _pairs(c), x.file_evolution(f, c), c).select("src", "src_file", "dst", "dst_file"), "fx_file_full", "fx_commit"),
        oracle("SELECT p.vcc_hash AS src, o.filename AS src_file, p.fc_hash AS dst, n.filename AS dst_file FROM pairs p JOIN fx_file o ON o.hash = p.vcc_hash JOIN fx_file n ON n.hash = p.fc_hash WHERE NOT EXISTS (SELECT 1 FROM evo e WHERE e.src = p.vcc_hash AND e.filename = o.filename) AND NOT EXISTS (SELECT 1 FROM fx_file t WHERE t.hash = p.fc_hash AND t.filename = o.filename)", pairs=_PAIRS, dated=_ALL_DATED, files=_FILES, evo=_EVO),
    ),
    "history_renames_within": (
        query(lambda f: x.renames_within(_renamed(f)).select("hash", "filename", "old", "new"), "fx_function"),
        oracle("SELECT hash, filename, max_by(name, {'s': start_line, 'n': name}) FILTER (before_change) AS old, max_by(name, {'s': start_line, 'n': name}) FILTER (NOT before_change) AS new FROM fx_function WHERE complexity > 20 GROUP BY 1, 2 HAVING bool_or(before_change) AND bool_or(NOT before_change)"),
    ),
    "history_rename_fallback": (
        query(lambda f, c: x.function_rename_fallback(_renamed(f), _pairs(c), c, x.function_evolution(f, c).select(F.col("src").alias("hash"), F.col("src_file").alias("filename"), "name")).drop("gap"), "fx_function_full", "fx_commit"),
        oracle("SELECT DISTINCT p.vcc_hash AS src, o.filename, o.name AS src_name, p.fc_hash AS dst, n.name AS dst_name FROM pairs p JOIN fx_function o ON o.hash = p.vcc_hash AND o.complexity > 20 JOIN fx_function n ON n.hash = p.fc_hash AND n.filename = o.filename WHERE NOT EXISTS (SELECT 1 FROM fns e WHERE e.hash = p.vcc_hash AND e.filename = o.filename AND e.name = o.name AND e.nx IS NOT NULL AND e.nx.h <> e.hash)", pairs=_PAIRS, dated=_ALL_DATED, fns=_FNS),
    ),
    "history_parents": (
        query(lambda c: x.parent_edges(_with_parents(c)).withColumn("is_merge", F.col("is_merge").cast("long")), "fx_commit"),
        oracle("SELECT p.hash AS src, c.hash AS dst, round(ln(1 + abs(floor(epoch(CAST(c.author_date AS TIMESTAMP) - CAST(p.author_date AS TIMESTAMP)) / 86400))), 6) AS log_days, CAST(len(parent_list) > 1 AS BIGINT) AS is_merge FROM (SELECT *, unnest(parent_list) AS parent FROM parents) c JOIN fx_commit p ON p.hash = c.parent", parents=_PARENTS),
    ),
    "history_precedes_undated": (
        query(lambda c: x.precedes(_undated(c)), "fx_commit"),
        oracle(f"SELECT src, dst, round(coalesce({_GAP.format('d', 'author_date')}, 0), 6) AS log_days FROM (SELECT hash AS src, author_date, lead(hash) OVER w AS dst, lead(author_date) OVER w AS d FROM dated WINDOW w AS (PARTITION BY repo_url ORDER BY coalesce(author_date, DATE '1970-01-01'), hash)) WHERE dst IS NOT NULL", dated=_DATED),
    ),
    "history_precedes": (query(x.precedes, "fx_commit"), oracle(f"SELECT src, dst, round({_GAP.format('d', 'author_date')}, 6) AS log_days FROM (SELECT hash AS src, author_date, lead(hash) OVER w AS dst, lead(author_date) OVER w AS d FROM fx_commit WINDOW w AS (PARTITION BY repo_url ORDER BY author_date, hash)) WHERE dst IS NOT NULL")),
    "history_precedes_globally": (query(x.precedes_globally, "fx_commit"), oracle(f"SELECT src, dst, round({_GAP.format('d', 'author_date')}, 6) AS log_days FROM (SELECT hash AS src, author_date, lead(hash) OVER w AS dst, lead(author_date) OVER w AS d FROM fx_commit WINDOW w AS (ORDER BY author_date, hash)) WHERE dst IS NOT NULL")),
    "history_padded_union": (
        query(lambda c, f: x.padded_union(n.commit_nodes(c), n.file_nodes(f)).groupBy(F.size("x").cast("long").alias("width")).agg(F.count("*").alias("n")), "fx_commit", "fx_file"),
        oracle("SELECT CAST(14 AS BIGINT) AS width, (SELECT count(*) FROM fx_commit) + (SELECT count(*) FROM fx_file) AS n"),
    ),
    "history_dense_ids": (query(lambda f: x.dense_ids(f.select("hash", F.col("filename").alias("node_key"))), "fx_file"), oracle("SELECT hash, filename AS node_key, row_number() OVER (ORDER BY hash, filename) - 1 AS id FROM fx_file")),
    "history_imputed": (
        query(lambda f: x.impute_empty(f.select("hash", F.col("filename").alias("node_key"), F.array(F.when(F.col("complexity") > 20, F.col("complexity")).otherwise(0).cast("double")).alias("x"))).select("hash", "node_key", F.col("x")[0].alias("value")), "fx_file"),
        oracle("SELECT hash, filename AS node_key, round(CASE WHEN complexity > 20 THEN complexity ELSE (SELECT avg(complexity) FROM fx_file WHERE complexity > 20) END, 6) AS value FROM fx_file"),
    ),
    "history_chain_candidates": (
        query(lambda c: x.chain_candidates(c.select(F.col("author").alias("cve_id"), F.col("hash").alias("fc_hash"), F.array((F.col("hash").cast("long") + 1).cast("string")).alias("vcc_list")), c), "fx_commit"),
        oracle("SELECT cve_id, count(*) AS n_commits, count(*) FILTER (h.hash IS NULL) AS n_new, count(*) FILTER (h.hash IS NULL) = 0 AS resolvable FROM (SELECT author AS cve_id, hash FROM fx_commit UNION SELECT author, CAST(CAST(hash AS BIGINT) + 1 AS STRING) FROM fx_commit) e LEFT JOIN fx_commit h ON h.hash = e.hash GROUP BY 1"),
    ),
    "history_clean_candidates": (
        query(lambda f, c: x.clean_candidates(f, f.where("complexity > 45").select(F.col("filename").alias("base")), c.where("label = 1").select("hash")), "fx_file", "fx_commit"),
        oracle("SELECT DISTINCT hash FROM fx_file WHERE filename IN (SELECT filename FROM fx_file WHERE complexity > 45) AND hash NOT IN (SELECT hash FROM fx_commit WHERE label = 1)"),
    ),
}
