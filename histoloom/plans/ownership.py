"""Queries on file ownership."""

from __future__ import annotations

from ..functions.shared import written
from ..operators import ownership as o
from .common import oracle, query, rs

_MATCHED = """SELECT o.*, coalesce(x.filename, b.filename) AS filename FROM fx_ownership o
LEFT JOIN (SELECT DISTINCT hash, filename FROM fx_file) x ON x.hash = o.commit_hash AND x.filename = o.file_path
LEFT JOIN (SELECT hash, string_split(filename, '/')[-1] AS base, max(filename) AS filename FROM fx_file GROUP BY 1, 2) b ON b.hash = o.commit_hash AND b.base = string_split(o.file_path, '/')[-1]
WHERE coalesce(x.filename, b.filename) IS NOT NULL"""
_STATS = """SELECT commit_hash AS hash, filename, ln(1 + count(CASE WHEN ownership_ratio >= 0.05 THEN 1 END)) AS owners, max(greatest(ownership_ratio, 0)) AS max_ratio,
sum(greatest(ownership_ratio, 0) ** 2) AS hhi, ln(1 + max(total_lines)) AS total FROM matched GROUP BY 1, 2"""
_EDGES = "SELECT f.hash, f.filename, coalesce(owners, 0) AS owners, coalesce(max_ratio, 0) AS max_ratio, coalesce(hhi, 0) AS hhi, coalesce(total, 0) AS total FROM (SELECT DISTINCT hash, filename FROM fx_file) f LEFT JOIN stats USING (hash, filename)"


def edges(files, ownership):
    named = written(files.select("hash", "filename").distinct(), "files")  # read three times below
    return o.commit_file_edges(named, o.file_ownership(o.match_files(named, ownership)))


QUERIES = {
    "ownership_concentration": (
        query(lambda c, f, w: o.concentration(c, edges(f, w)), "fx_commit", "fx_file", "fx_ownership"),
        oracle("SELECT repo_url, label, count(*) AS n_files, round(avg(hhi), 6) AS mean_hhi, round(avg(max_ratio), 6) AS mean_max_ratio, round(avg(owners), 6) AS mean_owners FROM fx_commit JOIN edges USING (hash) GROUP BY 1, 2", matched=_MATCHED, stats=_STATS, edges=_EDGES),
    ),
    "ownership_window_choice": (
        query(lambda w: o.choose_window(w).groupBy("window_days").agg(o.F.count("*").alias("n"), o.F.count_distinct("commit_hash").alias("commits")), "fx_ownership"),
        oracle("SELECT window_days, count(*) AS n, count(DISTINCT commit_hash) AS commits FROM fx_ownership JOIN best USING (commit_hash, window_days) GROUP BY 1", best="SELECT commit_hash, min(struct_pack(d := abs(window_days - 90), w := window_days)).w AS window_days FROM fx_ownership GROUP BY 1"),
    ),
    "ownership_matched_files": (
        query(lambda f, w: o.match_files(f, w).select("commit_hash", "file_path", "filename", "dev_email", "ownership_ratio"), "fx_file", "fx_ownership"),
        oracle(f"SELECT commit_hash, file_path, filename, dev_email, {rs('ownership_ratio')} FROM matched", matched=_MATCHED),
    ),
    "ownership_file_stats": (
        query(lambda f, w: o.file_ownership(o.match_files(f, w)), "fx_file", "fx_ownership"),
        oracle(f"SELECT hash, filename, {rs('owners', 'max_ratio', 'hhi', 'total')} FROM stats", matched=_MATCHED, stats=_STATS),
    ),
    "ownership_file_stats_author": (
        query(lambda f, w, r: o.file_ownership_with_author(o.match_files(f, w), r), "fx_file", "fx_ownership", "fx_commit_author"),
        oracle(
            "SELECT m.commit_hash AS hash, filename, round(ln(1 + count(DISTINCT m.dev_email)), 6) AS owners, round(sum(ownership_ratio ** 2), 6) AS hhi, round(max(ownership_ratio), 6) AS max_ratio, round(coalesce(max(CASE WHEN a.dev_id IS NOT NULL THEN ownership_ratio END), 0), 6) AS author_ratio FROM matched m LEFT JOIN (SELECT DISTINCT commit_hash, dev_id FROM fx_commit_author WHERE role = 'author') a ON a.commit_hash = m.commit_hash AND a.dev_id = m.dev_email GROUP BY 1, 2",
            matched=_MATCHED,
        ),
    ),
    "edge_commit_file_ownership": (
        query(edges, "fx_file", "fx_ownership"),
        oracle(f"SELECT hash, filename, {rs('owners', 'max_ratio', 'hhi', 'total')} FROM edges", matched=_MATCHED, stats=_STATS, edges=_EDGES),
    ),
}
