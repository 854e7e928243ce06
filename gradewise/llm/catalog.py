"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from gradewise.llm import (decontamination, fingerprints, language, licenses, lm_scores, merkle, near_dup, packing, quality_rules,
                           sharding, token_files, toxicity, whitening)

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_consistent_sampling": fingerprints.op3_consistent_sampling,
    "op4_sketch_near_dup": near_dup.op4_sketch_near_dup,
    "op5_stupid_backoff": lm_scores.op5_stupid_backoff,
    "op6_template_decontamination": decontamination.op6_template_decontamination,
    "op7_naive_bayes_language": language.op7_naive_bayes_language,
    "op8_diagonal_license_scan": licenses.op8_diagonal_license_scan,
    "op9_minimax_sharding": sharding.op9_minimax_sharding,
    "op10_gru_toxicity": toxicity.op10_gru_toxicity,
    "op11_compression_bands": quality_rules.op11_compression_bands,
    "op12_refined_whitening": whitening.op12_refined_whitening,
    "op13_interval_manifest": merkle.op13_interval_manifest,
}

ORACLE: dict[str, str] = {
    "op5_stupid_backoff": lm_scores.OP5_SQL,
    "op13_interval_manifest": merkle.OP13_SQL,
}
