"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from specloom.llm import chat, decontam, embdedup, linededup, lm, minhash, packing, secrets, tokencount, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op3_decontamination": decontam.query,
    "op4_line_dedup": linededup.query,
    "op2_lm_scoring": lm.query,
    "op5_token_counts": tokencount.query,
    "op6_embedding_dedup": embdedup.query,
    "op7_secrets": secrets.query,
    "op9_chat": chat.query,
    "op8_packing": packing.query,
    "op10_minhash": minhash.query,
}

SQL = {
    "op3_decontamination": decontam.SQL,
    "op4_line_dedup": linededup.SQL,
    "op6_embedding_dedup": embdedup.SQL,
    "op9_chat": chat.SQL,
    "op10_minhash": minhash.SQL,
}
