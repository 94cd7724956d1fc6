"""Whole graph tables from source tables: nodes (hash, type, node_key, x) and edges (hash, rel, src_type, src_key, dst_type, dst_key, attr)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import OWNER_SHARE, PULL_FEATURES, TAG_FEATURES, normal_key
from ..functions.shared import dealt, written_together
from . import cleaning, edges, nodes, ownership

#: Node types beside the commit that :func:`counted_graph` can leave out.
TYPES = ("files", "functions", "developers", "issues", "pull_requests", "tags")
#: What nodes and edges take from functions; their code stays in the source table.
_FUNCTION_COLUMNS = (
    "hash", "filename", "name", "start_line", "end_line", "num_lines_of_code", "complexity", "token_count", "length", "top_nesting_level", "function_change_type", "before_change", "is_hunk", "num_parameters", "parameters",
)


def typed(table: DataFrame, kind: str) -> DataFrame:
    return table.select("hash", F.lit(kind).alias("type"), "node_key", "x")


def relation(table: DataFrame, rel: str, src: str, dst: str, reverse: str | None = None, attr: Column | None = None) -> DataFrame:
    """Edges (hash, src_key, dst_key[, attr]) under a relation's name, and under ``reverse`` the other way with equal attributes."""
    own = attr if attr is not None else F.col("attr") if "attr" in table.columns else F.expr("cast(array() as array<double>)")
    table = table.select("hash", "src_key", "dst_key", own.alias("attr"))
    there = table.select("hash", F.lit(rel).alias("rel"), F.lit(src).alias("src_type"), "src_key", F.lit(dst).alias("dst_type"), "dst_key", "attr")
    if reverse is None:
        return there
    return there.unionByName(table.select("hash", F.lit(reverse).alias("rel"), F.lit(dst).alias("src_type"), F.col("dst_key").alias("src_key"), F.lit(src).alias("dst_type"), F.col("src_key").alias("dst_key"), "attr"))


def _all(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _from_commit(table: DataFrame) -> DataFrame:
    return table.select("hash", F.col("hash").alias("src_key"), F.col("node_key").alias("dst_key"))


def normalised_graph(tables: dict[str, DataFrame], window_days: int = 90, least: float = OWNER_SHARE, embeddings: DataFrame | None = None, hunk_embeddings: DataFrame | None = None, width: int = nodes.EMBEDDING_WIDTH) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the second generation, over normalised tables; every relation also in reverse.

    ``tables``: commit_info, commit_features, file_info, function_info, hunk_info, commit_author, ownership_window and developer_info
    (features by commit_hash and dev_email). Vectors have the embedding's width only where embeddings are given."""
    commits, features, files, functions, hunks, roles = (tables[t] for t in ("commit_info", "commit_features", "file_info", "function_info", "hunk_info", "commit_author"))
    owned = ownership.choose_window(tables["ownership_window"], window_days)
    matched, devs = written_together({"owned": dealt(ownership.match_files(files, owned), "commit_hash"), "developers": dealt(nodes.developers(roles, owned, least), "hash")}).values()
    file_x, hunk_x = nodes.file_nodes(files), nodes.hunk_nodes(hunks, hunk_embeddings, width)
    n = [typed(nodes.commit_nodes(commits, features), "commit"), typed(nodes.function_nodes(functions, embeddings, width), "function"), typed(file_x, "file"), typed(hunk_x, "hunk"), typed(nodes.developer_nodes(devs, tables["developer_info"]), "developer")]
    n += [typed(t, kind) for kind, t in nodes.process_nodes_v2(features).items()]
    stats = ownership.commit_file_edges(files, ownership.file_ownership(matched, least))
    of_file = stats.select("hash", F.col("hash").alias("src_key"), F.col("filename").alias("dst_key"), F.array("owners", "max_ratio", "hhi", "total").alias("attr"))
    named = edges.commit_developer_v2(roles, devs, features).select("hash", F.col("hash").alias("src_key"), F.col("email").alias("dst_key"), "rel", "attr")
    owns = edges.developer_file(matched, devs).select("hash", F.col("email").alias("src_key"), F.col("filename").alias("dst_key"), F.array("ratio", "line_share", "log_edits").alias("attr"))
    process = edges.commit_process_v2(features)
    e = [
        relation(of_file, "modifies_file", "commit", "file", "in_commit_file"),
        relation(edges.commit_function(functions), "modifies_func", "commit", "function", "in_commit_fn"),
        relation(_from_commit(hunk_x), "has_hunk", "commit", "hunk", "in_commit_hunk"),
        relation(edges.file_function(files, functions), "contains", "file", "function", "in_file"),
        relation(named.where("rel = 'authored_by'"), "authored_by", "commit", "developer", "authored"),
        relation(named.where("rel = 'committed_by'"), "committed_by", "commit", "developer", "committed"),
        relation(owns, "owns", "developer", "file", "owned_by"),
        relation(process["has_issue"], "has_issue", "commit", "issue", "linked_to_commit"),
        relation(process["has_pr"], "has_pr", "commit", "pull_request", "linked_to_commit"),
        relation(process["has_release"], "has_release", "commit", "release_tag", "release_of"),
    ]
    return _all(n), _all(e)


def _process_entities(tables: dict[str, DataFrame], commits: DataFrame, mode: int, kinds: Sequence[str], limits: dict[str, int | None]) -> dict[str, DataFrame]:
    """The entities of ``kinds`` that name a commit, each once and up to its limit; where a mode has one aggregate a commit, the commits that have any.
    None for the tags of mode 4: their node is made of the commit's features."""
    out = {}
    for kind, (name, key) in {"issue": ("issue_info", "issue_id"), "pull_request": ("pull_request_info", "pr_id"), "release_tag": ("release_tag_info", "tag_id")}.items():
        if kind not in kinds or (mode == 4 and kind == "release_tag"):
            continue
        found = nodes.first_entities(cleaning.entities_of(tables[name], commits), key, limits[kind])
        out[kind] = found if mode == 1 or (mode == 3 and kind == "release_tag") else found.select("hash").distinct()
    return out


def _cross(left: DataFrame, right: DataFrame, rel: str, src: str, dst: str, reverse: str, features: DataFrame | None, name: str) -> DataFrame:
    pairs = edges.between_types(left, right, first_only=True)
    return relation(pairs if features is None else edges.with_features(pairs, features, name), rel, src, dst, reverse)


def counted_graph(
    tables: dict[str, DataFrame], mode: int = 1, include: Sequence[str] = TYPES, window_days: int = 90, least: float = OWNER_SHARE, max_issues: int | None = None, max_prs: int | None = None, max_tags: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the first generation, over raw counts.

    ``mode``: 1 raw entities; 2 one engineered node a process type; 3 engineered issues and pull requests, raw tags; 4 as 3 with the
    previous tag parsed and the tag's context at the commit. ``include``: the node types of :data:`TYPES`; functions and developers need files.
    Limits keep the first entities of a commit by key. ``tables`` as :func:`load_tables` names them and commit_features."""
    commits, features, files = tables["commit_info"], tables["commit_features"], tables["file_info"]
    has = {t: t in include and (t not in ("functions", "developers") or "files" in include) for t in TYPES}
    n, e = [typed(nodes.commit_nodes_short(commits.join(features.select("hash", *[c for c in ("days_since_prev_tag", "tags_last_180d") if c in features.columns]), "hash", "left") if mode == 4 else commits, tags=mode == 4), "commit")], []
    owned = ownership.choose_window(tables["ownership_window"], window_days)
    kinds = [k for k, t in (("issue", "issues"), ("pull_request", "pull_requests"), ("release_tag", "tags")) if has[t]]
    read_often = _process_entities(tables, commits, mode, kinds, {"issue": max_issues, "pull_request": max_prs, "release_tag": max_tags})
    if has["files"]:
        read_often["owned"] = ownership.match_files(files, owned)
    if has["functions"]:
        known = cleaning.of_known_files(tables["function_info"], files, commits)
        read_often["functions"] = known.select(*[c for c in _FUNCTION_COLUMNS if c in known.columns])
    if has["developers"]:
        read_often["developers"] = nodes.developers_by_role_or_share(tables["commit_author"], commits, owned, least)
    stored = written_together({name: dealt(t, "commit_hash" if name == "owned" else "hash") for name, t in read_often.items()})
    if has["files"]:
        matched = stored["owned"]
        n.append(typed(nodes.file_nodes_counted(files, ownership.file_ownership_with_author(matched, tables["commit_author"])), "file"))
        e.append(relation(edges.commit_file_changes(files, commits=commits), "has", "commit", "file"))
    if has["functions"]:
        functions = stored["functions"]
        n.append(typed(nodes.function_nodes_short(functions), "function"))
        key = lambda c: F.concat_ws("::", "filename", c)
        e.append(relation(edges.file_function_shares(files, functions).select("hash", F.col("filename").alias("src_key"), key("name").alias("dst_key"), "attr"), "has", "file", "function"))
        e.append(relation(edges.co_modified(functions).select("hash", key("a").alias("src_key"), key("b").alias("dst_key"), F.array("nearness", "likeness").alias("attr")), "co_modified", "function", "function"))
    if has["developers"]:
        flags = stored["developers"]
        n.append(typed(nodes.developer_nodes_at_commit(flags, features, tables.get("developer_info")), "developer"))
        bot = F.array(edges.bot_flag(F.col("email")).cast("double"))
        for rel, flag in (("authored_by", "is_author"), ("committed_by", "is_committer")):
            e.append(relation(flags.where(F.col(flag) == 1).select("hash", F.col("hash").alias("src_key"), F.col("email").alias("dst_key"), bot.alias("attr")), rel, "commit", "developer"))
        owners = flags.where("is_owner = 1")
        strong = matched.withColumn("_e", normal_key(F.col("dev_email"))).join(flags.where("is_author = 1 OR is_committer = 1").select(F.col("hash").alias("commit_hash"), F.col("email").alias("_e"), F.lit(True).alias("_named")), ["commit_hash", "_e"], "left")
        strong = strong.where((F.col("ownership_ratio") >= least) | F.col("_named")).drop("_named", "_e")
        e.append(relation(edges.developer_file(strong, owners).select("hash", F.col("email").alias("src_key"), F.col("filename").alias("dst_key"), F.array("ratio", "line_share", "log_edits").alias("attr")), "owns", "developer", "file"))
    n_, e_ = _process(stored, kinds, features, mode)
    return _all(n + n_), _all(e + e_) if e + e_ else None


def _process(found, kinds, features, mode) -> tuple[list[DataFrame], list[DataFrame]]:
    """Process nodes of a mode, from the entities ``found`` of ``kinds``, with their edges to the commit, among each other, and in time."""
    n, e, x = [], [], {}
    known = features if mode in (2, 3) else None
    for kind, (rel, reverse, columns) in {"issue": ("linked_issue", "issue_of", None), "pull_request": ("linked_pr", "pr_of", PULL_FEATURES), "release_tag": ("has_release_tag", "tag_of", TAG_FEATURES)}.items():
        if kind not in kinds:
            continue
        key = {"issue": "issue_id", "pull_request": "pr_id", "release_tag": "tag_id"}[kind]
        if kind == "release_tag":
            x[kind] = nodes.release_nodes(found.get(kind), mode, features)
        else:
            x[kind] = nodes.issue_nodes(found[kind], key, mode, features, *([columns] if columns else []))
        n.append(typed(x[kind], kind))
        star = _from_commit(x[kind])
        e.append(relation(star if known is None else edges.with_features(star, known, rel), rel, "commit", kind, reverse))
    if "issue" in kinds and "pull_request" in kinds:
        if mode == 1:
            pairs = cleaning.references(found["pull_request"], found["issue"], [c for c in ("issue_id", "linked_issue_id", "closing_issue_id") if c in found["pull_request"].columns], [c for c in ("body", "title") if c in found["pull_request"].columns], "issue_id")
            e.append(relation(pairs.select("hash", F.col("pr_id").cast("string").alias("src_key"), F.col("issue_id").alias("dst_key")), "references_issue", "pull_request", "issue", "referenced_by_pr"))
        else:
            e.append(_cross(x["pull_request"], x["issue"], "references_issue", "pull_request", "issue", "referenced_by_pr", known, "references_issue"))
    if "release_tag" in kinds:
        for kind, there in (("pull_request", "affects_pr"), ("issue", "affects_issue")):
            if kind not in kinds:
                continue
            if mode == 4:  # the tag's context goes to the commit
                at_tag = x["release_tag"].select("hash").distinct().select("hash", F.col("hash").alias("node_key"))
                rel = {"pull_request": "tag_context_pr", "issue": "tag_context_issue"}[kind]
                e.append(_cross(at_tag, x[kind], rel, "commit", kind, "tag_context_of", features, "affects"))
            else:
                e.append(_cross(x["release_tag"], x[kind], there, "release_tag", kind, "in_release", known, "affects"))
    for kind, rel, reverse, key, times, modes in (
        ("issue", "next_issue", "prev_issue", "issue_id", ["created_at", "issue_created_at"], (1,)), ("pull_request", "next_pr", "prev_pr", "pr_id", ["created_at", "pr_created_at"], (1,)),
        ("release_tag", "next_tag", "prev_tag", "tag_id", ["created_at", "tagged_at", "published_at"], (1, 3)),
    ):
        if kind in kinds and mode in modes:
            e.append(relation(edges.time_chain(found[kind].withColumn(key, F.col(key).cast("string")), key, times), rel, kind, kind, reverse))
    return n, e
