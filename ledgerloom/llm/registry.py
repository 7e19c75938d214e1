"""The queries of this folder: op<N>_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, classifier, exact_dedup, extract, language_id, license_scan, lm_score, mixing, near_dedup, pii, quality, search, whitening

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_lm_score": lm_score.query,
    "op3_license_scan": license_scan.query,
    "op4_pii": pii.query,
    "op5_extract": extract.query,
    "op6_near_dedup": near_dedup.query,
    "op7_quality_rules": quality.query,
    "op8_mixing": mixing.query,
    "op9_language_id": language_id.query,
    "op10_bpe": bpe.query,
    "op11_quality_classifier": classifier.query,
    "op12_whitening": whitening.query,
    "op13_ranked_search": search.query,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op13_ranked_search": search.ORACLE,
}
