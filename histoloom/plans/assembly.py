"""Queries on process nodes, their edges by mode, whole graphs, their audits and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..functions import scalars as c
from ..functions.shared import scratch_path, written_together
from ..operators import assembly as a
from ..operators import audits as v
from ..operators import edges as e
from ..operators import graphs as g
from ..operators import nodes as n
from ..operators import scaling as s
from ..operators.cleaning import entities_of
from .common import oracle, query, query_by_commit, unwritten
from .graph import _FILE, _LOG, _hourly, _melt_sql, melt

_SOURCES = ["fx_commit_full", "fx_process", "fx_file_full", "fx_function_full", "fx_issue", "fx_pull", "fx_commit_author", "fx_ownership", "fx_developer"]


def _value(name: str) -> str:
    return _LOG.format(name) if name in c.LOGGED_COUNTS else f"coalesce(CAST({name} AS DOUBLE), 0)"


def _entities(view: str, columns: str) -> str:
    return f"SELECT DISTINCT h AS hash, {columns} FROM (SELECT *, unnest([fc_hash, vcc_hash]) AS h FROM {view}) WHERE h IN (SELECT hash FROM fx_commit)"


def _tags(commits):
    """Four release tags around each commit."""
    days = F.col("i") * 31 - F.pmod(F.col("hash").cast("int"), F.lit(90))
    rows = commits.select("hash", F.col("author_date").cast("timestamp").alias("t"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("i"))
    return rows.select(F.col("hash").alias("fc_hash"), F.lit(None).cast("string").alias("vcc_hash"), F.concat_ws("-", "hash", F.col("i").cast("string")).alias("tag_id"), F.concat(F.lit("v1."), F.col("i").cast("string")).alias("tag_name"), (F.col("i") * 2.5).alias("weight"), F.timestamp_seconds(F.unix_timestamp("t") + days * 86400).alias("created_at"))


def _tables(*views, often=tuple(_SOURCES)):
    """The source tables. The views of ``often``, which a graph reads more than once, are written first, as a loaded table would be, and lie by commit."""
    views = dict(zip(_SOURCES, views, strict=True))
    views |= written_together(unwritten({name: views[name] for name in often}))
    x, f, files, functions, issues, pulls, roles, owned, devs = views.values()
    typed = functions.join(x.select("hash", F.col("commit_type").alias("commit_label")), "hash")
    return {
        "commit_info": _hourly(x), "commit_features": f, "file_info": files, "function_info": typed.where("NOT is_hunk"), "hunk_info": typed.where("is_hunk"), "issue_info": issues, "pull_request_info": pulls,
        "release_tag_info": _tags(x), "commit_author": roles, "ownership_window": owned, "developer_info": devs,
    }


def _sizes(graph):
    return g.graph_totals(*graph)


#: What :func:`counted_graph` reads more than once. It writes functions and entities itself.
_OFTEN = ("fx_commit_full", "fx_process", "fx_file_full", "fx_commit_author", "fx_ownership")


def _counted(mode, often=_OFTEN, **more):
    return lambda *t: _sizes(a.counted_graph(_tables(*t, often=often), mode, **more))


_NAMED = "SELECT commit_hash AS hash, role, dev_id AS email FROM fx_commit_author UNION ALL SELECT hash, 'committer', committer FROM fx_commit_full WHERE hash NOT IN (SELECT commit_hash FROM fx_commit_author WHERE role = 'committer')"
_MATCH = "SELECT o.*, b.filename FROM fx_ownership o JOIN (SELECT hash, string_split(filename, '/')[-1] AS base, max(filename) AS filename FROM fx_file_full GROUP BY 1, 2) b ON b.hash = o.commit_hash AND b.base = string_split(o.file_path, '/')[-1]"
_CTES = {
    "named": _NAMED,
    "owners": "SELECT commit_hash AS hash, dev_email AS email FROM fx_ownership w WHERE ownership_ratio >= 0.05 OR EXISTS (SELECT 1 FROM named d WHERE d.hash = w.commit_hash AND d.email = w.dev_email)",
    "people": "SELECT DISTINCT hash, email FROM (SELECT hash, email FROM named UNION ALL SELECT hash, email FROM owners)",
    "matched": _MATCH,
    "issues": _entities("fx_issue", "issue_id, created_at"),
    "pulls": _entities("fx_pull", "pr_id, linked_issue_id, title, created_at"),
    "tags": "SELECT hash, i FROM fx_commit, range(4) r(i)",
    "fns": "SELECT hash, filename, name FROM fx_function_full WHERE NOT is_hunk",
    "refs": "SELECT p.hash, pr_id, i.issue_id FROM pulls p JOIN issues i ON i.hash = p.hash AND i.issue_id = p.linked_issue_id UNION SELECT p.hash, p.pr_id, i.issue_id FROM (SELECT *, unnest(regexp_extract_all(title, '#([0-9]+)', 1)) AS t FROM pulls) p JOIN issues i ON i.hash = p.hash AND CAST(i.issue_id AS BIGINT) = CAST(t AS BIGINT) WHERE NOT EXISTS (SELECT 1 FROM pulls d JOIN issues j ON j.hash = d.hash AND j.issue_id = d.linked_issue_id WHERE d.hash = p.hash AND d.pr_id = p.pr_id)",
}
_CODE = {
    ("node", "commit"): "SELECT count(*) FROM fx_commit", ("node", "file"): "SELECT count(*) FROM fx_file_full", ("node", "function"): "SELECT count(*) FROM fns", ("node", "developer"): "SELECT count(*) FROM people",
    ("edge", "has"): "SELECT (SELECT count(*) FROM fx_file_full) + (SELECT count(*) FROM fns)", ("edge", "co_modified"): "SELECT count(*) FROM fns x JOIN fns y USING (hash, filename) WHERE x.name <> y.name",
    ("edge", "authored_by"): "SELECT count(*) FROM (SELECT DISTINCT hash, email FROM named WHERE role = 'author')", ("edge", "committed_by"): "SELECT count(*) FROM (SELECT DISTINCT hash, email FROM named WHERE role = 'committer')",
    ("edge", "owns"): "SELECT count(*) FROM (SELECT DISTINCT m.commit_hash, dev_email, filename FROM matched m JOIN owners o ON o.hash = m.commit_hash AND o.email = m.dev_email WHERE ownership_ratio >= 0.05 OR EXISTS (SELECT 1 FROM named d WHERE d.hash = m.commit_hash AND d.email = m.dev_email))",
}
_HAS_I, _HAS_P = "SELECT count(DISTINCT hash) FROM issues", "SELECT count(DISTINCT hash) FROM pulls"
_BOTH = "SELECT count(*) FROM (SELECT hash FROM issues INTERSECT SELECT hash FROM pulls)"


def _counts(rows: dict[tuple[str, str], str]) -> str:
    body = " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{type_}' AS type, CAST(({sql}) AS BIGINT) AS n" for (kind, type_), sql in rows.items())
    return oracle(f"SELECT * FROM ({body}) WHERE n > 0", **_CTES)


def _chain(table: str) -> str:
    return f"SELECT coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM {table} GROUP BY hash)"


_RAW = {
    ("node", "issue"): "SELECT count(*) FROM issues", ("node", "pull_request"): "SELECT count(*) FROM pulls", ("node", "release_tag"): "SELECT count(*) FROM tags",
    ("edge", "linked_issue"): "SELECT count(*) FROM issues", ("edge", "issue_of"): "SELECT count(*) FROM issues", ("edge", "linked_pr"): "SELECT count(*) FROM pulls", ("edge", "pr_of"): "SELECT count(*) FROM pulls",
    ("edge", "has_release_tag"): "SELECT count(*) FROM tags", ("edge", "tag_of"): "SELECT count(*) FROM tags", ("edge", "references_issue"): "SELECT count(*) FROM refs", ("edge", "referenced_by_pr"): "SELECT count(*) FROM refs",
    ("edge", "affects_pr"): f"SELECT 4 * ({_HAS_P})", ("edge", "affects_issue"): f"SELECT 4 * ({_HAS_I})", ("edge", "in_release"): f"SELECT 4 * ({_HAS_P}) + 4 * ({_HAS_I})",
    ("edge", "next_issue"): _chain("issues"), ("edge", "prev_issue"): _chain("issues"), ("edge", "next_pr"): _chain("pulls"), ("edge", "prev_pr"): _chain("pulls"), ("edge", "next_tag"): _chain("tags"), ("edge", "prev_tag"): _chain("tags"),
}
_ALL_C = "SELECT count(*) FROM fx_commit"
_ONE = {
    ("node", "issue"): _HAS_I, ("node", "pull_request"): _HAS_P, ("node", "release_tag"): _ALL_C,
    ("edge", "linked_issue"): _HAS_I, ("edge", "issue_of"): _HAS_I, ("edge", "linked_pr"): _HAS_P, ("edge", "pr_of"): _HAS_P, ("edge", "has_release_tag"): _ALL_C, ("edge", "tag_of"): _ALL_C,
    ("edge", "references_issue"): _BOTH, ("edge", "referenced_by_pr"): _BOTH, ("edge", "affects_pr"): _HAS_P, ("edge", "affects_issue"): _HAS_I, ("edge", "in_release"): f"SELECT ({_HAS_P}) + ({_HAS_I})",
}
_PREV = "(SELECT hash FROM fx_process WHERE prev_tag_name IS NOT NULL OR days_since_prev_tag > 0)"
_AT_TAG = {
    **{k: sql for k, sql in _ONE.items() if k[1] not in ("affects_pr", "affects_issue", "in_release")},
    ("node", "release_tag"): f"SELECT count(*) FROM {_PREV}", ("edge", "has_release_tag"): f"SELECT count(*) FROM {_PREV}", ("edge", "tag_of"): f"SELECT count(*) FROM {_PREV}",
    ("edge", "tag_context_pr"): f"SELECT count(*) FROM (SELECT hash FROM pulls INTERSECT FROM {_PREV})", ("edge", "tag_context_issue"): f"SELECT count(*) FROM (SELECT hash FROM issues INTERSECT FROM {_PREV})",
    ("edge", "tag_context_of"): f"SELECT (SELECT count(*) FROM (SELECT hash FROM pulls INTERSECT FROM {_PREV})) + (SELECT count(*) FROM (SELECT hash FROM issues INTERSECT FROM {_PREV}))",
}


#: What :func:`normalised_graph` reads more than once; it takes no issues or pull requests.
_CODE_VIEWS = (*_OFTEN, "fx_function_full")
_CODE_USED = (*_CODE_VIEWS, "fx_developer")
#: What the process nodes and their edges are made of.
_PROCESS_USED = (*_OFTEN[:2], "fx_issue", "fx_pull")


def _graph_v2(*t):
    return a.normalised_graph(_tables(*t, often=_CODE_VIEWS), width=0)


def _errors(x, f, *rest):
    tables = _tables(x, f, *rest, often=_CODE_VIEWS)
    nodes, edges = a.normalised_graph(tables, width=0)
    # Some graphs are damaged: a developer missing, one direction of an edge, a file row.
    k = F.col("hash").cast("long")
    nodes = nodes.where(~((k % 5 == 0) & (F.col("type") == "developer")) & ~((k % 7 == 0) & (F.col("type") == "file")) & (k % 11 != 0))
    edges = edges.where(~((k % 3 == 0) & (F.col("rel") == "in_commit_file")))
    return v.graph_errors(nodes, edges, tables["commit_info"], {"file": tables["file_info"]}, {"modifies_file": "in_commit_file"})


def _small(x, files):
    nodes = n.commit_nodes_short(x).select("hash", F.lit("commit").alias("type"), "node_key", "x").unionByName(n.file_nodes(files).select("hash", F.lit("file").alias("type"), "node_key", "x"))
    edges = a.relation(e.commit_file_changes(files).select("hash", "src_key", "dst_key", "attr"), "modifies_func", "commit", "file", "in_commit_fn")
    return nodes, edges



def _ends(mode):
    """The ends of every edge of the process nodes, by relation."""

    def run(*t):
        edges = a.counted_graph(_tables(*t, often=_OFTEN[:2]), mode, include=("issues", "pull_requests", "tags"))[1]
        return edges.select("hash", "rel", "src_type", "src_key", "dst_type", "dst_key")

    return run


def _both_ways(rel, back, src, dst, sql):
    """``sql`` has hash, a and b: an edge from a to b, and its reverse."""
    return f"SELECT hash, '{rel}' AS rel, '{src}' AS src_type, a AS src_key, '{dst}' AS dst_type, b AS dst_key FROM ({sql}) UNION ALL SELECT hash, '{back}', '{dst}', b, '{src}', a FROM ({sql})"


def _chain_ends(table, key, time):
    return f"SELECT * FROM (SELECT hash, {key} AS a, lead({key}) OVER (PARTITION BY hash ORDER BY {time}, {key}) AS b FROM {table}) WHERE b IS NOT NULL"


_TAG_NODES = "SELECT hash, hash || '-' || CAST(i AS VARCHAR) AS k, i FROM tags"
_ONE_I, _ONE_P = "SELECT DISTINCT hash, 'all' AS k FROM issues", "SELECT DISTINCT hash, 'all' AS k FROM pulls"
_RAW_I, _RAW_P = "SELECT hash, issue_id AS k FROM issues", "SELECT hash, pr_id AS k FROM pulls"


def _first_of(left, right):
    return f"SELECT l.hash, l.k AS a, r.k AS b FROM ({left}) l JOIN (SELECT hash, min(k) AS k FROM ({right}) GROUP BY 1) r ON r.hash = l.hash"


def _star_ends(nodes):
    return f"SELECT hash, hash AS a, k AS b FROM ({nodes})"


def _ends_of(i, p, t, refs, more):
    parts = [_both_ways("linked_issue", "issue_of", "commit", "issue", _star_ends(i)), _both_ways("linked_pr", "pr_of", "commit", "pull_request", _star_ends(p)), _both_ways("has_release_tag", "tag_of", "commit", "release_tag", _star_ends(t)), _both_ways("references_issue", "referenced_by_pr", "pull_request", "issue", refs)]
    return " UNION ALL ".join(parts + more)


_TAG_CHAIN = _both_ways("next_tag", "prev_tag", "release_tag", "release_tag", _chain_ends(f"({_TAG_NODES})", "k", "i"))


def _affected(i, p, t):
    return [_both_ways("affects_pr", "in_release", "release_tag", "pull_request", _first_of(t, p)), _both_ways("affects_issue", "in_release", "release_tag", "issue", _first_of(t, i))]


_PREV_NODES = f"SELECT hash, 'prev' AS k FROM {_PREV}"
_AT_COMMIT = f"SELECT hash, hash AS k FROM {_PREV}"
_ENDS_SQL = {
    1: _ends_of(_RAW_I, _RAW_P, _TAG_NODES, "SELECT hash, pr_id AS a, issue_id AS b FROM refs", [*_affected(_RAW_I, _RAW_P, _TAG_NODES), _TAG_CHAIN, _both_ways("next_issue", "prev_issue", "issue", "issue", _chain_ends("issues", "issue_id", "created_at")), _both_ways("next_pr", "prev_pr", "pull_request", "pull_request", _chain_ends("pulls", "pr_id", "created_at"))]),
    3: _ends_of(_ONE_I, _ONE_P, _TAG_NODES, _first_of(_ONE_P, _ONE_I), [*_affected(_ONE_I, _ONE_P, _TAG_NODES), _TAG_CHAIN]),
    4: _ends_of(_ONE_I, _ONE_P, _PREV_NODES, _first_of(_ONE_P, _ONE_I), [_both_ways("tag_context_pr", "tag_context_of", "commit", "pull_request", _first_of(_AT_COMMIT, _ONE_P)), _both_ways("tag_context_issue", "tag_context_of", "commit", "issue", _first_of(_AT_COMMIT, _ONE_I))]),
}
_KINDS = {"issue": c.ISSUE_FEATURES_V2, "pull_request": c.PULL_FEATURES_V2, "release_tag": c.TAG_FEATURES_V2}
_OF_FEATURES = {"has_issue": "linked_to_commit", "has_pr": "linked_to_commit", "has_release": "release_of"}
_MASKED = ["keep_developer_only", "keep_process_only", "keep_edges_only", "keep_nodes_only", "developer", "developer_features", "process"]


def _variants(features, owned, roles):
    """How many values other than 0 each mask leaves, by type of node or relation and dim. Owners and roles are read once a relation."""
    stored = written_together({"owned": owned.select("commit_hash", "file_path", "dev_email", "ownership_ratio", "lines_owned", "edits_in_window"), "roles": roles, "features": features})
    owned, roles, features = stored["owned"], stored["roles"], stored["features"]
    pair = lambda df, *x: df.select(F.col("commit_hash").alias("hash"), F.col("commit_hash").alias("src_key"), F.col(x[0]).alias("dst_key"), F.array(*[F.col(y).cast("double") if isinstance(y, str) else F.lit(y) for y in x[1:]]).alias("attr"))
    nodes = owned.select(F.col("commit_hash").alias("hash"), F.lit("developer").alias("type"), F.concat_ws("|", "file_path", "dev_email").alias("node_key"), F.array(F.col("ownership_ratio").cast("double"), F.col("lines_owned").cast("double")).alias("x"))
    for kind, table in n.process_nodes_v2(features).items():
        nodes = nodes.unionByName(a.typed(table, kind))
    edges = a.relation(pair(owned, "file_path", "edits_in_window", "ownership_ratio"), "owns", "developer", "file", "owned_by")
    for role, there, back in (("author", "authored_by", "authored"), ("committer", "committed_by", "committed")):
        edges = edges.unionByName(a.relation(pair(roles.where(F.col("role") == role), "dev_id", 1.0, 2.0), there, "commit", "developer", back))
    for there, back in _OF_FEATURES.items():
        star = features.select(F.col("hash").alias("commit_hash"), F.lit("all").alias("key"), "repo_commits_last_90d")
        edges = edges.unionByName(a.relation(pair(star, "key", "repo_commits_last_90d"), there, "commit", "process", back))
    masks = {name: s.named_mask(features.sparkSession, name) for name in _MASKED}
    left = [s.values_left(table, masks, by, vector).withColumn("part", F.lit(part)) for part, table, by, vector in (("node", nodes, "type", "x"), ("edge", edges, "rel", "attr"))]
    return left[0].unionByName(left[1]).select("mask", "part", "type", "dim", "n")


_VALUES = [("node", "developer", d, v, "fx_ownership") for d, v in enumerate(("ownership_ratio", "lines_owned"))]
_VALUES += [("node", kind, d, f"coalesce({v}, 0)", "fx_process") for kind, names in _KINDS.items() for d, v in enumerate(names)]
_VALUES += [("edge", rel, d, v, "fx_ownership") for rel in ("owns", "owned_by") for d, v in enumerate(("edits_in_window", "ownership_ratio"))]
_VALUES += [("edge", rel, d, "1", f"(SELECT * FROM fx_commit_author WHERE role = '{role}')") for role, rels in (("author", ("authored_by", "authored")), ("committer", ("committed_by", "committed"))) for rel in rels for d in (0, 1)]
_VALUES += [("edge", rel, 0, "repo_commits_last_90d", "fx_process") for pair in _OF_FEATURES.items() for rel in pair]
_EVERYTHING = " UNION ALL ".join(f"SELECT '{part}' AS part, '{kind}' AS type, CAST({d} AS BIGINT) AS dim, count(*) FILTER ({v} <> 0) AS n FROM {source}" for part, kind, d, v, source in _VALUES)
_ALL_PROCESS, _ALL_ROLES = ["issue", "pull_request", "release_tag"], ["authored_by", "authored", "committed_by", "committed"]
_ALL_LINKS = ["has_issue", "has_pr", "linked_to_commit", "has_release", "release_of"]
_GONE = {"keep_developer_only": _ALL_PROCESS + _ALL_LINKS, "keep_process_only": ["developer", *_ALL_ROLES], "keep_edges_only": ["developer", *_ALL_PROCESS], "keep_nodes_only": _ALL_ROLES + _ALL_LINKS, "developer": ["developer", *_ALL_ROLES, "owns", "owned_by"], "developer_features": ["developer"], "process": _ALL_PROCESS}
_ZEROED = " UNION ALL ".join(f"SELECT '{mask}' AS mask, unnest({kinds}) AS type" for mask, kinds in _GONE.items())
_VARIANTS_SQL = f"SELECT m.mask, part, e.type, dim, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM zeroed z WHERE z.mask = m.mask AND z.type = e.type) THEN 0 ELSE n END) AS BIGINT) AS n FROM everything e, (SELECT unnest({_MASKED}) AS mask) m GROUP BY ALL"


#: What :func:`_damaged` puts wrong.
_DAMAGES = oracle(
    "SELECT 'width' AS problem, (SELECT count(*) FROM files WHERE complexity = 7) AS n UNION ALL SELECT 'not_finite', (SELECT count(*) FROM files WHERE complexity = 9) UNION ALL SELECT 'dangling', 2 * (SELECT count(*) FROM files WHERE complexity = 11) UNION ALL SELECT 'empty_end', 0 UNION ALL SELECT 'too_many_nodes', (SELECT count(*) FROM (SELECT hash FROM files WHERE complexity <> 11 GROUP BY 1 HAVING count(*) >= 3)) UNION ALL SELECT 'no_repository', (SELECT count(*) FROM fx_commit_full WHERE merge) UNION ALL SELECT 'other_label', (SELECT count(*) FROM fx_commit_full WHERE NOT in_main_branch)",
    files="SELECT hash, filename, complexity FROM fx_file",
)

QUERIES = {
    "node_process_v2": (
        query(lambda f: _stacked(n.process_nodes_v2(f)), "fx_process"),
        oracle(" UNION ALL ".join(_melt_sql("fx_process", f"'{kind}' AS type, hash", cols) for kind, cols in (("issue", c.ISSUE_FEATURES_V2), ("pull_request", c.PULL_FEATURES_V2), ("release_tag", c.TAG_FEATURES_V2)))),
    ),
    "node_issue_raw": (
        query(lambda i, x: melt(n.issue_nodes(n.first_entities(entities_of(i, x), "issue_id", 3), "issue_id", 1, None)), "fx_issue", "fx_commit"),
        oracle(_melt_sql("firsts", "hash, issue_id AS node_key", ["votes", "comments"]), firsts="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY issue_id) AS rn FROM every) WHERE rn <= 3".replace("every", f"({_entities('fx_issue', 'issue_id, votes, comments, created_at')})")),
    ),
    "node_issue_engineered": (
        query(lambda i, x, f: melt(n.issue_nodes(entities_of(i, x), "issue_id", 2, f), "x", "hash"), "fx_issue", "fx_commit", "fx_process"),
        oracle(_melt_sql("known", "hash", [_value(x) for x in c.ISSUE_FEATURES]), known=f"SELECT * FROM fx_process WHERE hash IN (SELECT hash FROM ({_entities('fx_issue', 'issue_id')}))"),
    ),
    "node_pull_engineered": (
        query(lambda i, x, f: melt(n.issue_nodes(entities_of(i, x), "pr_id", 3, f, c.PULL_FEATURES), "x", "hash"), "fx_pull", "fx_commit", "fx_process"),
        oracle(_melt_sql("known", "hash", [_value(x) for x in c.PULL_FEATURES]), known=f"SELECT * FROM fx_process WHERE hash IN (SELECT hash FROM ({_entities('fx_pull', 'pr_id')}))"),
    ),
    "node_tag_parsed": (
        query(lambda f: melt(n.release_nodes(None, 4, f), "x", "hash"), "fx_process"),
        oracle(
            _melt_sql("parsed", "hash", ["major", "minor", "0", "CAST(tag LIKE '%rc%' AS INT)", "0", "CAST(major > 0 AND minor = 0 AS INT)", "-ln(1 + days_since_prev_tag)"]),
            named="SELECT hash, coalesce(prev_tag_name, CASE WHEN days_since_prev_tag > 0 THEN 'v0.0' END) AS tag, days_since_prev_tag FROM fx_process",
            parsed="SELECT *, CAST(regexp_extract(tag, '([0-9]+)\\.([0-9]+)', 1) AS BIGINT) AS major, CAST(regexp_extract(tag, '([0-9]+)\\.([0-9]+)', 2) AS BIGINT) AS minor FROM named WHERE tag IS NOT NULL",
        ),
    ),
    "node_tag_neighbours": (
        query(lambda f: melt(n.neighbour_tags(f.select("hash", F.col("prev_tag_name").alias("prev_tag"), "days_since_prev_tag", F.when(F.col("has_issue_pr_gap") == 1, F.lit("v9")).alias("next_tag"), F.lit(4).alias("days_to_next_tag")))), "fx_process"),
        oracle(_melt_sql("sides", "hash, node_key", ["days", "is_prev"]), sides="SELECT hash, 'prev:' || prev_tag_name AS node_key, ln(1 + days_since_prev_tag) AS days, 1 AS is_prev FROM fx_process WHERE prev_tag_name IS NOT NULL UNION ALL SELECT hash, 'next:v9', ln(5), 0 FROM fx_process WHERE has_issue_pr_gap = 1"),
    ),
    "node_developer_at_commit": (
        query(lambda r, x, w, f: melt(n.developer_nodes_at_commit(n.developers_by_role_or_share(r, x, w), f)), "fx_commit_author", "fx_commit_full", "fx_ownership", "fx_process"),
        oracle(_melt_sql("known", "hash, node_key", [_value(x) for x in c.DEVELOPER_AT_COMMIT]), **{k: _CTES[k] for k in ("named", "owners", "people")}, known="SELECT hash, email AS node_key, f.* EXCLUDE (hash) FROM people JOIN fx_process f USING (hash)"),
    ),
    "node_developer_totals": (
        query(lambda r, x, w, d: melt(n.developer_nodes_at_commit(n.developers_by_role_or_share(r, x, w), x, d.withColumn("dev_commits_before", F.col("repo_active_weeks_before")))).where("dim = 1"), "fx_commit_author", "fx_commit_full", "fx_ownership", "fx_developer"),
        oracle(
            "SELECT hash, email AS node_key, CAST(1 AS BIGINT) AS dim, round(coalesce(ln(1 + w), 0), 6) AS value FROM people LEFT JOIN best USING (email)", **{k: _CTES[k] for k in ("named", "owners", "people")},
            best="SELECT dev_email AS email, repo_active_weeks_before AS w FROM (SELECT *, row_number() OVER (PARTITION BY dev_email ORDER BY total_commits DESC, commit_hash) AS rn FROM fx_developer) WHERE rn = 1",
        ),
    ),
    "edge_process_v2": (
        query(lambda f: _stacked(e.commit_process_v2(f), "attr"), "fx_process"),
        oracle(" UNION ALL ".join(_melt_sql("fx_process", f"'{rel}' AS type, hash", cols) for rel, cols in (("has_issue", c.ISSUE_EDGE_V2), ("has_pr", c.ISSUE_EDGE_V2), ("has_release", c.TAG_EDGE_V2)))),
    ),
    "edge_with_features": (
        query(lambda i, x, f: melt(e.with_features(entities_of(i, x).select("hash", F.col("hash").alias("src_key"), F.col("issue_id").alias("dst_key")), f, "references_issue"), "attr", "hash", "dst_key"), "fx_issue", "fx_commit", "fx_process"),
        oracle(_melt_sql("every", "hash, issue_id AS dst_key", ["pr_to_issue_open_ratio_90d", "has_issue_pr_gap"]), every=f"SELECT * FROM ({_entities('fx_issue', 'issue_id, votes, comments, created_at')}) JOIN fx_process USING (hash)"),
    ),
    "edge_time_chain_reverse": (
        query(lambda i, x: e.with_reverse(e.time_chain(entities_of(i, x), "issue_id", ["opened_at", "created_at"]), "next_issue", "prev_issue"), "fx_issue", "fx_commit"),
        oracle("SELECT hash, a AS src_key, b AS dst_key, 'next_issue' AS rel FROM pairs UNION ALL SELECT hash, b, a, 'prev_issue' FROM pairs", pairs=f"SELECT * FROM (SELECT hash, issue_id AS a, lead(issue_id) OVER (PARTITION BY hash ORDER BY created_at, issue_id) AS b FROM ({_entities('fx_issue', 'issue_id, votes, comments, created_at')})) WHERE b IS NOT NULL"),
    ),
    "edge_all_pairs": (
        query(lambda i, p, x: e.between_types(n.entity_nodes(entities_of(i, x), "issue_id"), n.entity_nodes(entities_of(p, x), "pr_id")), "fx_issue", "fx_pull", "fx_commit"),
        oracle(f"SELECT hash, issue_id AS src_key, pr_id AS dst_key FROM ({_entities('fx_issue', 'issue_id, votes, comments, created_at')}) JOIN ({_entities('fx_pull', 'pr_id, additions, linked_issue_id, title, created_at')}) USING (hash)"),
    ),
    "graph_mode_raw": (query_by_commit(_counted(1), *_SOURCES), _counts(_CODE | _RAW)),
    "graph_mode_engineered": (query_by_commit(_counted(2), *_SOURCES), _counts(_CODE | _ONE)),
    "graph_mode_hybrid": (
        query_by_commit(_counted(3), *_SOURCES),
        _counts(_CODE | _ONE | {k: sql for k, sql in _RAW.items() if k[1] in ("release_tag", "has_release_tag", "tag_of", "affects_pr", "affects_issue", "in_release", "next_tag", "prev_tag")}),
    ),
    "graph_mode_tag_context": (query_by_commit(_counted(4), *_SOURCES), _counts(_CODE | _AT_TAG)),
    "graph_without_code": (query(_counted(1, _OFTEN[:1], include=("issues", "tags"), max_issues=2, max_tags=1), *_SOURCES), _counts({
        ("node", "commit"): _ALL_C, ("node", "issue"): "SELECT sum(least(k, 2)) FROM (SELECT count(*) AS k FROM issues GROUP BY hash)", ("node", "release_tag"): _ALL_C,
        ("edge", "linked_issue"): "SELECT sum(least(k, 2)) FROM (SELECT count(*) AS k FROM issues GROUP BY hash)", ("edge", "issue_of"): "SELECT sum(least(k, 2)) FROM (SELECT count(*) AS k FROM issues GROUP BY hash)",
        ("edge", "has_release_tag"): _ALL_C, ("edge", "tag_of"): _ALL_C, ("edge", "affects_issue"): _HAS_I, ("edge", "in_release"): _HAS_I,
        ("edge", "next_issue"): "SELECT sum(least(k, 2) - 1) FROM (SELECT count(*) AS k FROM issues GROUP BY hash)", ("edge", "prev_issue"): "SELECT sum(least(k, 2) - 1) FROM (SELECT count(*) AS k FROM issues GROUP BY hash)",
    })),
    "graph_v2_sizes": (
        query_by_commit(lambda *t: _sizes(_graph_v2(*t)).where("kind = 'node' OR type IN ('has_hunk', 'contains', 'has_issue', 'in_commit_hunk')"), *_SOURCES, used=_CODE_USED),
        _counts({
            ("node", "commit"): _ALL_C, ("node", "file"): "SELECT count(*) FROM fx_file_full", ("node", "function"): "SELECT count(*) FROM fns", ("node", "hunk"): "SELECT count(*) FROM fx_function_full WHERE is_hunk",
            ("node", "developer"): "SELECT count(*) FROM (SELECT commit_hash, dev_id FROM fx_commit_author UNION SELECT commit_hash, dev_email FROM fx_ownership WHERE ownership_ratio >= 0.05)", ("node", "issue"): _ALL_C, ("node", "pull_request"): _ALL_C, ("node", "release_tag"): _ALL_C,
            ("edge", "has_hunk"): "SELECT count(*) FROM fx_function_full WHERE is_hunk", ("edge", "in_commit_hunk"): "SELECT count(*) FROM fx_function_full WHERE is_hunk", ("edge", "contains"): "SELECT count(*) FROM fns", ("edge", "has_issue"): _ALL_C,
        }),
    ),
    "audit_published_graphs": (
        query(lambda *t: _published(*t), "fx_commit_full", "fx_file"),
        _DAMAGES,
    ),
    "graph_published_manifest": (
        query(lambda *t: _published(*t, manifest=True), "fx_commit_full", "fx_file"),
        oracle("SELECT c.hash, label, CASE WHEN NOT merge THEN repo_url END AS repo_url, {nodes} AS n_nodes, 2 * coalesce(k, 0) AS n_edges FROM fx_commit_full c LEFT JOIN (SELECT hash, count(*) AS k, count(*) FILTER (complexity <> 11) AS kept FROM fx_file GROUP BY 1) f ON f.hash = c.hash".format(nodes="1 + coalesce(kept, 0)")),
    ),
    "audit_graph_errors": (
        query_by_commit(_errors, *_SOURCES, used=_CODE_USED),
        oracle(
            "SELECT hash, errors FROM (SELECT hash, array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'missing_graph' END, CASE WHEN has AND (k % 7 = 0 OR k % 11 = 0) THEN 'count_file' END, CASE WHEN NOT has OR k % 5 = 0 OR k % 11 = 0 THEN 'no_developer' END, CASE WHEN NOT has THEN 'no_author_edge' END, CASE WHEN has AND k % 3 = 0 THEN 'back_modifies_file' END], lambda x: x IS NOT NULL), ',') AS errors FROM (SELECT hash, CAST(hash AS BIGINT) AS k, hash IN (SELECT hash FROM fx_file) AS has FROM fx_commit)) WHERE errors <> ''"
        ),
    ),
    "audit_graph_problems": (
        query(lambda *t: _problems(*t), "fx_commit_full", "fx_file"),
        _DAMAGES,
    ),
    "audit_one_hot": (
        query(lambda f: v.one_hot_problems(e.commit_file_changes(f).withColumn("attr", F.when(F.col("dst_key") > "Brand#3", F.transform("attr", lambda y: y * 2)).otherwise(F.col("attr"))), "attr", 0, 6), "fx_file"),
        oracle("SELECT count(*) FILTER (filename > 'Brand#3') AS n_bad, count(*) AS n FROM fx_file"),
    ),
    "graph_filled_attributes": (
        query(lambda f: melt(g.with_attributes(e.commit_file_changes(f).withColumn("attr", F.when(F.col("dst_key") < "Brand#3", F.col("attr"))), 10), "attr", "hash", "dst_key").groupBy("dim").agg(F.sum("value").alias("total"), F.count("*").alias("n")).where("dim < 6"), "fx_file"),
        oracle(" UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS dim, CAST(count(*) FILTER (change_type = '{k}' AND filename < 'Brand#3') AS DOUBLE) AS total, count(*) AS n FROM fx_file" for i, k in enumerate(c.FILE_CHANGES))),
    ),
    "graph_extra_embedding": (
        query(lambda f, w: melt(g.with_extra(n.file_nodes(f), w.where("vec_id < 300").select(F.col("vec_id").cast("string").alias("hash"), F.lit("Brand#11").alias("node_key"), F.col("embedding").alias("emb")), 64)).where("dim >= 3 AND value <> 0"), "fx_file", "embeddings"),
        oracle("SELECT hash, filename AS node_key, CAST(2 + i AS BIGINT) AS dim, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM fx_file JOIN embeddings ON CAST(vec_id AS STRING) = hash AND vec_id < 300, range(1, 65) r(i) WHERE filename = 'Brand#11' AND round(CAST(embedding[i] AS DOUBLE), 6) <> 0"),
    ),
    "graph_named_edges": (
        query(lambda x, f: g.named_edges(_small(x, f)[1].withColumn("attr", F.concat("attr", F.array(F.log1p(F.length("src_key").cast("double"))))), _small(x, f)[0], c.FILE_CHANGES, 0, 10), "fx_commit_full", "fx_file"),
        oracle("SELECT hash, 'modifies_func' AS rel, hash AS src_key, filename AS dst_key, change_type AS kind, CAST(length(hash) AS BIGINT) AS days FROM fx_file UNION ALL SELECT hash, 'in_commit_fn', filename, hash, change_type, length(filename) FROM fx_file"),
    ),
    "mask_pruned": (
        query(lambda f, x: melt(s.apply_mask(n.commit_nodes(_hourly(x), f).withColumn("type", F.lit("commit")), s.named_mask(x.sparkSession, "pruned", "pruned_v2"))).where("value <> 0").groupBy("dim").agg(F.count("*").alias("n")), "fx_process", "fx_commit_full"),
        oracle("SELECT * FROM (SELECT CAST(0 AS BIGINT) AS dim, count(*) FILTER (in_main_branch) AS n FROM fx_commit_full UNION ALL SELECT 1, count(*) FILTER (merge) FROM fx_commit_full UNION ALL SELECT 8, count(*) FILTER (abs(round(cos((hour(authored_at) + minute(authored_at) / 60) * 6.283185307179586 / 24), 6)) > 0 OR (hour(authored_at) + minute(authored_at) / 60) IN (6, 18)) FROM fx_commit_full UNION ALL SELECT 9, count(*) FILTER (isodow(authored_at) <> 1) FROM fx_commit_full UNION ALL SELECT 11, count(*) FILTER (has_sdlc_data <> 0) FROM fx_process UNION ALL SELECT 12, count(*) FILTER (repo_commits_last_90d <> 0) FROM fx_process UNION ALL SELECT 13, count(*) FILTER (repo_active_authors_90d <> 0) FROM fx_process) WHERE n > 0"),
    ),
    **{f"graph_ends_{name}": (query_by_commit(_ends(mode), *_SOURCES, used=_PROCESS_USED), oracle(_ENDS_SQL[mode], **_CTES)) for mode, name in ((1, "raw"), (3, "hybrid"), (4, "tag_context"))},
    "mask_variants": (query(_variants, "fx_process", "fx_ownership", "fx_commit_author"), oracle(_VARIANTS_SQL, zeroed=_ZEROED, everything=_EVERYTHING)),
    "mask_configuration": (
        query(lambda x, f: melt(s.configured(*_small(x, f), "no_fn_categorical")[1], "attr", "hash", "rel", "dst_key").where("dim < 9 AND rel = 'modifies_func'"), "fx_commit_full", "fx_file"),
        oracle(_melt_sql("fx_file", "hash, 'modifies_func' AS rel, filename AS dst_key", [*[f"CAST(change_type = '{k}' AS INT)" for k in c.FILE_CHANGES], "0", "0", "0"])),
    ),
    "mask_file_metrics": (
        query(lambda x, f: melt(s.configured(*_small(x, f), "full_model")[0]).groupBy("dim").agg(F.sum("value").alias("total")), "fx_commit_full", "fx_file"),
        oracle(" UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS dim, round(sum({x}), 6) AS total FROM fx_commit_full" for i, x in enumerate([*[_LOG.format(f"num_{y}") for y in ("lines_deleted", "lines_added", "lines_changed", "files_changed")], *[f"coalesce(dmm_unit_{y}, 0)" for y in ("size", "complexity", "interfacing")]]))),
    ),
    "mask_embedding_tail": (
        query(lambda f, w: _totals(s.apply_mask(_tailed(f, w), s.mask_table(f.sparkSession, [("hunk", -64, -1), ("hunk", -900, -1)]))), "fx_file", "embeddings"),
        oracle(f"SELECT filename AS node_key, round(sum({' + '.join(_FILE)}), 6) AS total, 67 * count(*) AS n FROM fx_file GROUP BY 1"),
    ),
}


def _stacked(tables, vector: str = "x"):
    out = None
    for kind, t in tables.items():
        part = melt(t.withColumn("type", F.lit(kind)), vector, "type", "hash")
        out = part if out is None else out.unionByName(part)
    return out


def _tailed(files, vectors):
    """File nodes with a shared vector behind their own values."""
    one = vectors.where("vec_id = 1").select(F.col("embedding").cast("array<double>").alias("embedding"))
    return n.file_nodes(files).join(F.broadcast(one)).select("hash", F.lit("hunk").alias("type"), "node_key", F.concat("x", "embedding").alias("x"))


def _totals(nodes):
    """Sum and number of the values of each key's vectors, which are added up before their rows meet."""
    own = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return nodes.select("node_key", own.alias("_sum"), F.size("x").alias("_n")).groupBy("node_key").agg(F.sum("_sum").alias("total"), F.sum("_n").alias("n"))


def _named_apart(commits):
    """Merges without a repository, and labels that differ off the main branch."""
    return commits.withColumn("repo_url", F.when(~F.col("merge"), F.col("repo_url"))), commits.select("hash", F.when(F.col("in_main_branch"), F.col("label")).otherwise(2).alias("label"))


def _stored(commits, files):
    """Both views, written first: nodes, marks, edges and audits read them several times."""
    return written_together({"commits": commits, "files": files}).values()


def _problems(commits, files):
    commits, files = _stored(commits, files)
    return v.graph_problems(*_damaged(commits, files), {"commit": 7, "file": 3}, 3, *_named_apart(commits))


def _published(commits, files, manifest=False):
    path = scratch_path(commits.sparkSession, "graphs")
    commits, files = _stored(commits, files)
    nodes, edges = _damaged(commits, files)
    listed, labelled = _named_apart(commits)
    found = api.publish_graphs(nodes, edges, listed, path, {"commit": 7, "file": 3}, 3, labelled)
    return commits.sparkSession.read.parquet(f"{path}/manifest") if manifest else found


def _damaged(x, files):
    """A small graph with wrong widths, bad numbers and missing nodes, by the files' complexity, the last value of their vectors."""
    nodes, edges = _small(x, files)
    nodes = nodes.withColumn("_c", F.when(F.col("type") == "file", F.get("x", F.lit(2)))).where("_c IS NULL OR _c <> 11")
    bad = F.when(F.col("_c") == 7, F.slice("x", 1, 2)).when(F.col("_c") == 9, F.transform("x", lambda _: F.lit(float("nan")))).otherwise(F.col("x"))
    return nodes.withColumn("x", bad).drop("_c"), edges
