"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from keyloom.llm import chat, decontaminate, language, licenses, neardup, neighbours, pieces, pii, secrets, toxicity

QUERIES = {
    "op10_nearest": neighbours.op10,
    "op1_license_scan": licenses.op1,
    "op2_secrets": secrets.op2,
    "op3_toxicity": toxicity.op3,
    "op4_chat_format": chat.op4,
    "op5_sentencepiece": pieces.op5,
    "op6_pii": pii.op6,
    "op7_language_id": language.op7,
    "op8_decontaminate": decontaminate.op8,
    "op8_proximity": decontaminate.op8_proximity,
    "op9_near_duplicates": neardup.op9,
}
ORACLES = {
    "op4_chat_format": chat.OP4_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
}
