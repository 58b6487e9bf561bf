"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from candela.llm import bpe, chat, decontam, jaccard, langid, lm, packing, passages, periods, resample, secrets, token_files, vectors

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_secrets": secrets.op2_secrets,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_langid": langid.op4_langid,
    "op5_tokens": token_files.op5_tokens,
    "op6_decontam": decontam.op6_decontam,
    "op7_vectors": vectors.op7_vectors,
    "op8_bpe": bpe.op8_bpe,
    "op9_lm": lm.op9_lm,
    "op10_passages": passages.op10_passages,
    "op11_resample": resample.op11_resample,
    "op12_packing": packing.op12_packing,
    "op13_periods": periods.op13_periods,
}
ORACLE = {
    "op1_chat": chat.OP1_SQL,
    "op3_jaccard": jaccard.OP3_SQL,
    "op7_vectors": vectors.OP7_SQL,
    "op10_passages": passages.OP10_SQL,
}
