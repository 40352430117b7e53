"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from riskmon.llm import licenses, minhash, mixing, negatives, packing, pii, quality, rules, search, substrings, suffixes, toxicity, whitening


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_suffix_dedup": suffixes.op1_suffix_dedup,
        "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
        "op3_pii": pii.op3_pii,
        "op4_quality_rules": rules.op4_quality_rules,
        "op5_quality_classifier": quality.op5_quality_classifier,
        "op6_exact_top_k": search.op6_exact_top_k,
        "op7_substring_dedup": substrings.op7_substring_dedup,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_whitening": whitening.op11_whitening,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_license_scan": licenses.op13_license_scan,
    }


def oracle_sql() -> dict:
    return {
        "op1_suffix_dedup": suffixes.SQL,
        "op2_minhash_near_dedup": minhash.SQL,
        "op4_quality_rules": rules.SQL,
        "op6_exact_top_k": search.SQL,
        "op7_substring_dedup": substrings.SQL,
        "op10_mix_sources": mixing.SQL,
        "op12_hard_negatives": negatives.SQL,
    }
