"""The queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import fingerprints, language_id, line_dedup, packing, pii, quality_classifier, quality_rules, sentencepiece, simhash, url_filter

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_sentencepiece": sentencepiece.op5_sentencepiece,
    "op6_pii": pii.op6_pii,
    "op7_packing": packing.op7_packing,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_simhash": simhash.op10_simhash,
}
ORACLE_SQL = {"op2_line_dedup": line_dedup.SQL, "op8_url_filter": url_filter.SQL}
