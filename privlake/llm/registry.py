"""The queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from privlake.llm import centroid_clustering, decontamination, fingerprint, jaccard_join, lm_scoring, packing, pii, quality_rules, secret_scan, token_output, toxicity, url_filter, whitening

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_pii": pii.op2_pii,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_benchmark_decontamination": decontamination.op7_benchmark_decontamination,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_token_output": token_output.op10_token_output,
    "op11_whitening": whitening.op11_whitening,
    "op12_fingerprint": fingerprint.op12_fingerprint,
    "op13_centroid_clustering": centroid_clustering.op13_centroid_clustering,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op5_url_filter": url_filter.ORACLE,
    "op7_benchmark_decontamination": decontamination.ORACLE,
    "op8_quality_rules": quality_rules.oracle(),
    "op13_centroid_clustering": centroid_clustering.oracle(),
}
