"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op1_quality_rules, op2_sharding, op3_quality_classifier, op4_url_filters, op5_packing, op6_toxicity, op7_ngram_jaccard, op8_html_text, op9_mixing, op10_embedding_dedup, op11_token_alignment, op12_suffix_dedup, op13_hard_negatives

QUERIES = {
    "op1_quality_rules": op1_quality_rules.query,
    "op2_sharding": op2_sharding.query,
    "op3_quality_classifier": op3_quality_classifier.query,
    "op4_url_filters": op4_url_filters.query,
    "op5_packing": op5_packing.query,
    "op6_toxicity": op6_toxicity.query,
    "op7_ngram_jaccard": op7_ngram_jaccard.query,
    "op8_html_text": op8_html_text.query,
    "op9_mixing": op9_mixing.query,
    "op10_embedding_dedup": op10_embedding_dedup.query,
    "op11_token_alignment": op11_token_alignment.query,
    "op12_suffix_dedup": op12_suffix_dedup.query,
    "op13_hard_negatives": op13_hard_negatives.query,
}

ORACLE_SQL = {
    "op4_url_filters": op4_url_filters.ORACLE_SQL,
    "op7_ngram_jaccard": op7_ngram_jaccard.ORACLE_SQL,
    "op10_embedding_dedup": op10_embedding_dedup.ORACLE_SQL,
    "op13_hard_negatives": op13_hard_negatives.ORACLE_SQL,
}
