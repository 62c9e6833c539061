"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from sitelumen.llm import centroids, decontaminate, divergence, lm_scoring, ngram_join, packing, quality, sharding, simhash, spotsigs, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_spotsigs_fingerprints": spotsigs.op3_spotsigs_fingerprints,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_extendible_sharding": sharding.op6_extendible_sharding,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_centroid_clustering": centroids.op11_centroid_clustering,
    "op12_ngram_jaccard_join": ngram_join.op12_ngram_jaccard_join,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLE_SQL = {
    "op6_extendible_sharding": sharding.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op11_centroid_clustering": centroids.ORACLE,
    "op12_ngram_jaccard_join": ngram_join.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
