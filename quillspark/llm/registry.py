"""The queries of this folder, and SQL that gives their rows where SQL can express them."""

from __future__ import annotations

from . import decontaminate, embeddings, html_text, langid, linedup, mixing, pii, secrets, sharding, simhash

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_language_id": langid.op2_language_id,
    "op3_line_dedup": linedup.op3_line_dedup,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_embedding_near_dedup": embeddings.op8_embedding_near_dedup,
    "op9_html_text": html_text.op9_html_text,
    "op10_sharding": sharding.op10_sharding,
}

ORACLE_SQL = {
    "op3_line_dedup": linedup.OP3_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op7_mix_sources": mixing.OP7_SQL,
    "op8_embedding_near_dedup": embeddings.OP8_SQL,
    "op10_sharding": sharding.OP10_SQL,
}
