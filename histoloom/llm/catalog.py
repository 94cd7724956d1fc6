"""The queries that the entry module registers for this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprints, infill, interactions, jaccard, language, packing, quality, sharding, suffixes, token_files, topk, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_one_permutation": fingerprints.op1_one_permutation,
        "op2_signature_trees": jaccard.op2_signature_trees,
        "op2_signature_links": jaccard.op2_signature_links,
        "op3_subword_softmax": language.op3_subword_softmax,
        "op4_sparse_suffixes": suffixes.op4_sparse_suffixes,
        "op5_url_filters": url_filter.op5_url_filters,
        "op6_byte_shards": sharding.op6_byte_shards,
        "op7_separator_scan": token_files.op7_separator_scan,
        "op8_bound_certified": packing.op8_bound_certified,
        "op9_nb_svm": quality.op9_nb_svm,
        "op10_suffix_automaton": decontaminate.op10_suffix_automaton,
        "op11_fenwick_infill": infill.op11_fenwick_infill,
        "op12_histogram_topk": topk.op12_histogram_topk,
        "op13_filter_interactions": interactions.op13_filter_interactions,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_filters": url_filter.ORACLE,
        "op10_suffix_automaton": decontaminate.ORACLE,
        "op11_fenwick_infill": infill.ORACLE,
        "op12_histogram_topk": topk.ORACLE,
        "op13_filter_interactions": interactions.ORACLE,
    }
