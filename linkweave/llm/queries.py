"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from linkweave.llm import bpe, embedding_dedup, licences, line_dedup, mixing, quality, secrets, simhash, topk, toxicity

QUERIES = {
    "op1_quality": quality.op1_query,
    "op2_toxicity": toxicity.op2_query,
    "op3_secret_scan": secrets.op3_query,
    "op4_simhash_near_dedup": simhash.op4_query,
    "op5_embedding_near_dedup": embedding_dedup.op5_query,
    "op6_licence_scan": licences.op6_query,
    "op7_line_dedup": line_dedup.op7_query,
    "op8_byte_bpe": bpe.op8_query,
    "op9_mix_sources": mixing.op9_query,
    "op10_exact_top_k": topk.op10_query,
}

SQL = {
    "op5_embedding_near_dedup": embedding_dedup.OP5_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op10_exact_top_k": topk.OP10_SQL,
}
