"""The queries of the thirteen operations, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from quire.llm import ann, collocations, conversations, exact_topk, html_extract, mixing, near_dup, pii, secrets, sentencepiece_codec, substrings, toxicity, url_filter

QUERIES = {
    "op9_html_extract": html_extract.op9_html_extract,
    "op4_mixing": mixing.op4_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_near_dup": near_dup.op7_near_dup,
    "op1_ann": ann.op1_ann,
    "op10_exact_topk": exact_topk.op10_exact_topk,
    "op3_url_filter": url_filter.op3_url_filter,
    "op8_secrets": secrets.op8_secrets,
    "op2_pii": pii.op2_pii,
    "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
    "op11_collocations": collocations.op11_collocations,
    "op12_substring_dedup": substrings.op12_substring_dedup,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}
ORACLE: dict[str, str] = {
    "op2_pii": pii.OP2_SQL,
    "op7_near_dup": near_dup.OP7_SQL,
    "op8_secrets": secrets.OP8_SQL,
    "op10_exact_topk": exact_topk.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_substring_dedup": substrings.OP12_SQL,
    "op13_conversation_repair": conversations.OP13_SQL,
}
