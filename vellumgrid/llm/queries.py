"""The queries of this subpackage and the SQL that they are checked against."""

from __future__ import annotations

from vellumgrid.llm import alignment, bpe, filter_audit, html_text, language_id, language_model, mixing, quality, secret_scan, simhash, substrings, topk, toxicity

QUERIES = {
    "op1_language_model": language_model.op1_language_model,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_html_text": html_text.op3_html_text,
    "op4_simhash": simhash.op4_simhash,
    "op5_topk": topk.op5_topk,
    "op6_secrets": secret_scan.op6_secrets,
    "op7_bpe": bpe.op7_bpe,
    "op8_substrings": substrings.op8_substrings,
    "op9_quality": quality.op9_quality,
    "op10_mixing": mixing.op10_mixing,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_alignment": alignment.op12_alignment,
    "op13_language_id": language_id.op13_language_id,
}
SQL = {
    "op5_topk": topk.OP5_SQL,
    "op8_substrings": substrings.OP8_SQL,
    "op9_quality": quality.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
}
