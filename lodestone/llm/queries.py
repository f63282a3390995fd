"""The registered queries of this package and the SQL they are held against."""

from __future__ import annotations

from . import decontaminate, filter_audit, fingerprint, html_text, language_id, line_dedup, lm_score, mixing, near_dedup, quality, spelling, tokens, toxicity

QUERIES = {
    "op1_lm_score": lm_score.query,
    "op2_fingerprint": fingerprint.query,
    "op3_toxicity": toxicity.query,
    "op4_line_dedup": line_dedup.query,
    "op5_token_counts": tokens.query,
    "op6_html_text": html_text.query,
    "op7_mixing": mixing.query,
    "op8_near_dedup": near_dedup.query,
    "op9_language_id": language_id.query,
    "op10_decontaminate": decontaminate.query,
    "op11_filter_audit": filter_audit.query,
    "op12_spelling": spelling.query,
    "op13_quality_rules": quality.query,
}

SQL = {
    "op4_line_dedup": line_dedup.SQL,
    "op8_near_dedup": near_dedup.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_spelling": spelling.SQL,
}
