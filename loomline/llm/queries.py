"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontamination, html_text, neighbours, piece_coding, simhash, source_audit, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter, whitening

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_url_filter": url_filter.query,
    "op4_toxicity": toxicity.query,
    "op5_simhash": simhash.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_neighbours": neighbours.query,
    "op8_html_text": html_text.query,
    "op9_piece_coding": piece_coding.query,
    "op10_decontamination": decontamination.query,
    "op11_whitening": whitening.query,
    "op12_source_audit": source_audit.query,
    "op13_chat_format": chat_format.query,
}

ORACLES: dict[str, str] = {"op2_substring_dedup": substring_dedup.SQL, "op3_url_filter": url_filter.SQL, "op10_decontamination": decontamination.SQL, "op12_source_audit": source_audit.SQL, "op13_chat_format": chat_format.SQL}
