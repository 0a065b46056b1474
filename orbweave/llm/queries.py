"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontam, fingerprint, idstore, jaccard, langid, packing, secrets, tokencount, toxicity


def queries() -> dict:
    return {
        "op1_chat": chat.op1_chat,
        "op2_decontamination": decontam.op2_decontamination,
        "op3_token_counts": tokencount.op3_token_counts,
        "op4_jaccard": jaccard.op4_jaccard,
        "op5_fingerprint": fingerprint.op5_fingerprint,
        "op6_language_id": langid.op6_language_id,
        "op7_packing": packing.op7_packing,
        "op8_secrets": secrets.op8_secrets,
        "op9_token_ids": idstore.op9_token_ids,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard": jaccard.oracle(), "op5_fingerprint": fingerprint.oracle()}
