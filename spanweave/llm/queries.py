"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from spanweave.llm import annulus, audit, bpe, chat, langid, linededup, mixing, quality, simhash, tokenfiles, topk, toxicity, urlfilter

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_exact_top_k": topk.op3_exact_top_k,
    "op4_bpe": bpe.op4_bpe,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_url_filter": urlfilter.op8_url_filter,
    "op9_simhash_golay": simhash.op9_simhash_golay,
    "op10_chat_format": chat.op10_chat_format,
    "op11_token_files": tokenfiles.op11_token_files,
    "op12_annulus_clusters": annulus.op12_annulus_clusters,
    "op13_filter_audit": audit.op13_filter_audit,
}

ORACLES = {
    "op3_exact_top_k": topk.OP3_SQL,
    "op5_line_dedup": linededup.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op10_chat_format": chat.OP10_SQL,
    "op12_annulus_clusters": annulus.OP12_SQL,
    "op13_filter_audit": audit.OP13_SQL,
}
