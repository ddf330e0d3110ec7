"""The registered queries of this subpackage and the SQL to compare them with."""

from __future__ import annotations

from annalist.llm import embedding_dedup, language_id, media_ts, minhash_dedup, mixing, packing, pii, substring_dedup, token_counts, url_reputation

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_pii": pii.op2,
    "op3_media_ts": media_ts.op3,
    "op4_packing": packing.op4,
    "op5_token_counts": token_counts.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_minhash_dedup": minhash_dedup.op7,
    "op8_url_reputation": url_reputation.op8,
    "op9_embedding_dedup": embedding_dedup.op9,
    "op10_language_id": language_id.op10,
}

SQL = {
    "op1_mixing": mixing.SQL,
    "op8_url_reputation": url_reputation.SQL,
}
