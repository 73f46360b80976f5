"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import bpe, cpsjoin, decontam, dialogue, fmindex, frames, k2treap, langid, linededup, pfp, quality, secrets, urls

QUERIES = {
    "op1_seekable_token_frames": frames.op1_seekable_token_frames,
    "op2_language_id": langid.op2_language_id,
    "op3_fm_index_dedup": fmindex.op3_fm_index_dedup,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_url_filters": urls.op5_url_filters,
    "op6_chosen_path_near_dedup": cpsjoin.op6_chosen_path_near_dedup,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_template_decontamination": decontam.op8_template_decontamination,
    "op9_pfp_dedup": pfp.op9_pfp_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_k2_treap_search": k2treap.op11_k2_treap_search,
    "op12_conversation_repair": dialogue.op12_conversation_repair,
    "op13_secret_ledger": secrets.op13_secret_ledger,
}

ORACLES = {"op5_url_filters": urls.OP5_SQL}
