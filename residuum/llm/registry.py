"""Queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from residuum.llm import fingerprints, html_text, jaccard_join, language_id, quality_grades, quality_votes, sequence_packing, source_mix, toxicity, url_rules

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_html_text": html_text.query,
    "op3_source_mix": source_mix.query,
    "op4_toxicity": toxicity.query,
    "op5_fingerprints": fingerprints.query,
    "op6_sequence_packing": sequence_packing.query,
    "op7_quality_grades": quality_grades.query,
    "op8_url_filters": url_rules.query,
    "op9_quality_rules": quality_votes.query,
    "op10_jaccard_join": jaccard_join.query,
    # Parts of operators that SQL can say too.
    "mix_targets": source_mix.targets_query,
    "edited_texts": fingerprints.edited_query,
    "quality_base_counts": quality_votes.base_query,
}
ORACLES = {
    "op2_html_text": html_text.ORACLE,
    "op8_url_filters": url_rules.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
    "mix_targets": source_mix.TARGETS_ORACLE,
    "edited_texts": fingerprints.EDITED_ORACLE,
    "quality_base_counts": quality_votes.BASE_ORACLE,
}
