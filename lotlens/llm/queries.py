"""Registry of the training-data queries, picked up by the entry point."""

from __future__ import annotations

from . import chat_format, decontaminate, html_text, jaccard_join, paragraph_dedup, pieces, quality_model, quality_rules, suffix_dedup, url_filter

QUERIES = {
    "op1_decontamination": decontaminate.query,
    "op2_html_extraction": html_text.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_quality_rules": quality_rules.query,
    "op5_chat_formatting": chat_format.query,
    "op6_paragraph_dedup": paragraph_dedup.query,
    "op7_url_filters": url_filter.query,
    "op8_quality_classifier": quality_model.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_sentencepiece": pieces.query,
}

SQL = {
    "op1_decontamination": decontaminate.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op5_chat_formatting": chat_format.SQL,
    "op7_url_filters": url_filter.SQL,
}
