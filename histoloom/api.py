"""The library's main entry points. Each takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalars import OWNER_SHARE
from .functions.shared import written
from .operators import assembly, attribution, audits, graphs, history, history_graph, metrics, scaling, splits
from .operators import runs as run_tables
from .sources.tables import load_tables, write_observed, write_report, write_split

STRATEGIES = {
    "repo": splits.by_repo, "temporal": splits.by_time, "repo_temporal": splits.by_repo_and_time, "cwe": splits.by_weakness, "severity": splits.by_severity,
    "hard_negatives": splits.by_hard_negatives, "graph_size": splits.by_graph_size, "cold_start": splits.cold_start, "developer": splits.by_identity, "file": splits.by_identity, "function": splits.by_identity,
}


def build_graph_tables(
    tables: dict[str, DataFrame], mode: int = 1, include: tuple[str, ...] = assembly.TYPES, ownership_window_days: int = 90, ownership_threshold: float = OWNER_SHARE, max_issues: int | None = None, max_prs: int | None = None, max_tags: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all commits, over raw counts: see :func:`operators.assembly.counted_graph`."""
    return assembly.counted_graph(tables, mode, include, ownership_window_days, ownership_threshold, max_issues, max_prs, max_tags)


def build_graph_tables_v2(tables: dict[str, DataFrame], ownership_window_days: int = 90, ownership_threshold: float = OWNER_SHARE, embeddings: DataFrame | None = None, hunk_embeddings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all commits, over normalised tables: see :func:`operators.assembly.normalised_graph`."""
    return assembly.normalised_graph(tables, ownership_window_days, ownership_threshold, embeddings, hunk_embeddings)


def build_history_graph(tables: dict[str, DataFrame], hashes: DataFrame | None = None, mode: int = 4, parent_edges: bool = True, temporal_edges: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one graph over many commits, those of ``hashes`` (hash) where given: see :func:`operators.history_graph.history_graph`, which
    takes the ``options``. :func:`number_graph` gives its nodes ids by type."""
    if hashes is not None:
        tables = tables | {"commit_info": tables["commit_info"].join(hashes.select("hash").distinct(), "hash", "left_semi")}
        for name in ("commit_features", "file_info", "function_info"):
            tables[name] = tables[name].join(tables["commit_info"].select("hash"), "hash", "left_semi")
        for name in ("commit_author", "ownership_window"):
            tables[name] = tables[name].join(tables["commit_info"].select(F.col("hash").alias("commit_hash")), "commit_hash", "left_semi")
    return history_graph.history_graph(tables, mode, parents=parent_edges, order=temporal_edges, **options)


def split(commits: DataFrame, name: str, tables: dict[str, DataFrame] | None = None, **options) -> DataFrame:
    """``commits`` with repo_split by the named strategy. Developers, files and functions come from ``tables`` (commit_author, file_info,
    function_info) unless ``owners`` and ``identity`` are given."""
    if name in IDENTITIES and "owners" not in options:
        source, key, columns = IDENTITIES[name]
        options = {"owners": (tables or {})[source].withColumnRenamed(key, "hash"), "identity": columns} | options
    return STRATEGIES[name](commits, **options)


def summarise_runs(runs: DataFrame, metrics_: tuple[str, ...], best_by: str, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """(keys, metric, mean, std, n, result) over seeds: each seed's metrics on val at its best epoch by ``best_by``. ``runs``: keys, seed, epoch, split, metrics."""
    by = [*keys, "seed"]
    best = run_tables.best_epochs(runs, best_by, by).select(*by, "epoch")
    at_best = runs.where("split = 'val'").join(best, [*by, "epoch"])
    return run_tables.result_text(metrics.seed_summary(at_best, list(keys), list(metrics_)))


IDENTITIES = {"developer": ("commit_author", "commit_hash", ["dev_id"]), "file": ("file_info", "hash", ["filename"]), "function": ("function_info", "hash", ["name", "filename"])}


def validate_split(split_: DataFrame, strategy: str) -> DataFrame:
    """(strategy, finding, n, status)."""
    rows = [("in_several_splits", audits.in_several_splits(split_)), ("repo_overlap", audits.overlap(split_, "repo_url")), ("commit_overlap", audits.overlap(split_, "hash")), ("problems", audits.split_problems(split_))]
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(strategy).alias("strategy"), F.lit(f).alias("finding"), "n") for f, t in rows]
    counts.append(audits.future_leak(split_).select(F.lit(strategy).alias("strategy"), F.lit("future_leak").alias("finding"), F.col("n_future").alias("n")))
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return audits.verdicts(every)


def publish_split(split_: DataFrame, path: str, strategy: str) -> None:
    """The split index, its summary by part and the findings of its validation, each under ``path`` and the strategy's name."""
    write_split(split_, f"{path}/index", strategy)
    write_report(audits.split_summary(split_).withColumn("strategy", F.lit(strategy)), f"{path}/metadata/{strategy}")
    write_report(validate_split(split_, strategy), f"{path}/leakage/{strategy}")


def publish_graphs(nodes: DataFrame, edges: DataFrame, commits: DataFrame, path: str, width: int | dict[str, int], most: int = 100_000, labelled: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """Writes graphs under ``path`` as ``nodes`` (a folder a type), ``edges`` (a folder a relation), ``manifest`` (hash, label, repo_url, n_nodes,
    n_edges; one row a commit) and, where given, ``rejected`` (hash, reason; JSON), and returns their audit (problem, n).

    Vectors and empty ends are checked by the tasks that write them, so no vector is read again; the manifest, the bounds and the
    dangling ends come from one union by key of the written keys. Problems are those of :func:`operators.audits.graph_problems`, in which
    empty tables have none. Repeated nodes and edges count as often as they stand."""
    spark = nodes.sparkSession
    seen = write_observed(nodes, f"{path}/nodes", "type", audits.node_checks(width)) | write_observed(edges, f"{path}/edges", "rel", audits.edge_checks())
    kept_nodes, kept_edges = (spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in (("nodes", nodes), ("edges", edges)))
    counts = written(audits.graph_counts(kept_nodes, kept_edges), "graph-counts")
    of_commit = commits.select("hash", "label", "repo_url").join(counts.select("hash", "n_nodes", "n_edges"), "hash", "left").na.fill(0, ["n_nodes", "n_edges"])
    of_commit.write.mode("overwrite").parquet(f"{path}/manifest")
    if rejected is not None:
        write_report(rejected, f"{path}/rejected")
    observed = spark.createDataFrame([(name, seen[name]) for name in ("width", "not_finite", "empty_end")], "problem string, n long")
    return observed.unionByName(audits.count_problems(counts, most, commits, labelled))


def evaluate(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rates at 0.5, average precision, ROC area and the best swept threshold, by ``keys``."""
    parts = [metrics.rates(metrics.confusion(scored, keys)), metrics.average_precision(scored, keys), metrics.roc_auc(scored, keys), metrics.best_threshold_sweep(scored, keys)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys)) if keys else out.join(F.broadcast(p))
    return out


fit_scaler, apply_scaler = scaling.fit_scaler, scaling.apply_scaler
mask, named_mask = scaling.apply_mask, scaling.named_mask
shapley, kernel_shap = attribution.shapley, attribution.kernel_shap
repo_commits, manifest = history.repo_commits, graphs.manifest
number_graph = history_graph.numbered

__all__ = ["apply_scaler", "build_graph_tables", "build_graph_tables_v2", "build_history_graph", "evaluate", "fit_scaler", "kernel_shap", "load_tables", "manifest", "mask", "named_mask", "number_graph", "publish_graphs", "publish_split", "repo_commits", "shapley", "split", "summarise_runs", "validate_split"]
