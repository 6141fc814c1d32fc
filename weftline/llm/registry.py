"""Queries of this subpackage for the entry file, with their SQL."""

from __future__ import annotations

from weftline.llm import (
    centroid_clusters,
    decontaminate,
    exact_dedup,
    line_dedup,
    lm_score,
    merkle_manifest,
    ngram_join,
    quality,
    secret_scan,
    source_mix,
    substring_dedup,
    tree_search,
    url_filter,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_source_mix": source_mix.query,
    "op3_line_dedup": line_dedup.query,
    "op4_secret_scan": secret_scan.query,
    "op5_ngram_join": ngram_join.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_lm_score": lm_score.query,
    "op8_quality": quality.query,
    "op9_url_filter": url_filter.query,
    "op10_decontaminate": decontaminate.query,
    "op11_centroid_clusters": centroid_clusters.query,
    "op12_tree_search": tree_search.query,
    "op13_merkle_manifest": merkle_manifest.query,
}

ORACLES = {
    "op2_source_mix": source_mix.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op11_centroid_clusters": centroid_clusters.ORACLE,
    "op13_merkle_manifest": merkle_manifest.ORACLE,
}
