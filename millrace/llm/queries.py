"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from millrace.llm import decontaminate, fingerprints, html_extract, language_id, license_scan, mixing, ngram_join, substring_dedup, token_counts, warc

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_mixing": mixing.query,
    "op3_ngram_join": ngram_join.query,
    "op4_license_scan": license_scan.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_language_id": language_id.query,
    "op7_decontaminate": decontaminate.query,
    "op8_fingerprints": fingerprints.query,
    "op9_html_extract": html_extract.query,
    "op10_warc": warc.query,
}

SQL = {
    "op3_ngram_join": ngram_join.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op10_warc": warc.SQL,
}
