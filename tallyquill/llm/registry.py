"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tallyquill.llm import ann, chat, exact_dedup, filter_audit, html_text, mixing, near_dedup, secrets, spelling, subword, token_counts, topk, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_sentencepiece": subword.op3_sentencepiece,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_chat_format": chat.op6_chat_format,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_html_text": html_text.op10_html_text,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_nearest": ann.op13_nearest,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op6_chat_format": chat.ORACLE,
    "op7_exact_topk": topk.ORACLE,
    "op8_minhash_near_dedup": near_dedup.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
