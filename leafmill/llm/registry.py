"""Registered queries of the text operators and their SQL counterparts."""

from leafmill.llm import (
    exact_dedup, mixing, near_dedup, pii, quality, secrets, sentencepiece_nbest, sharding, spelling, substring, token_counts, toxicity,
    whitening,
)

QUERIES = {
    "op1_nbest": sentencepiece_nbest.op1_nbest,
    "op2_compression_bands": quality.op2_compression_bands,
    "op3_soft_membership": mixing.op3_soft_membership,
    "op4_lpt": sharding.op4_lpt,
    "op5_tree_merge": exact_dedup.op5_tree_merge,
    "op6_order_minhash": near_dedup.op6_order_minhash,
    "op7_weak_supervision": pii.op7_weak_supervision,
    "op8_randomness": secrets.op8_randomness,
    "op9_boosted_trees": toxicity.op9_boosted_trees,
    "op10_count_min": substring.op10_count_min,
    "op11_sturm_whitening": whitening.op11_sturm_whitening,
    "op12_two_tier": token_counts.op12_two_tier,
    "op13_q_chunks": spelling.op13_q_chunks,
}

ORACLES = {
    "op5_tree_merge": exact_dedup.OP5_SQL,
    "op10_count_min": substring.OP10_SQL,
    "op13_q_chunks": spelling.OP13_SQL,
}
