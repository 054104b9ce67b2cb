"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, clustering, decontamination, exact_dedup, langid, minhash, packing, quality, reassembly, sharding, topk, toxicity

QUERIES = {
    "op1_topk_search": topk.op1,
    "op2_chat_format": chat.op2,
    "op3_packing": packing.op3,
    "op4_toxicity": toxicity.op4,
    "op5_sharding": sharding.op5,
    "op6_byte_bpe": bpe.op6,
    "op7_quality": quality.op7,
    "op8_minhash_dedup": minhash.op8,
    "op9_exact_dedup": exact_dedup.op9,
    "op10_language_id": langid.op10,
    "op11_reassembly": reassembly.op11,
    "op12_centroids": clustering.op12,
    "op13_decontamination": decontamination.op13,
}

ORACLES = {"op1_topk_search": topk.OP1_SQL, "op2_chat_format": chat.OP2_SQL, "op9_exact_dedup": exact_dedup.OP9_SQL, "op11_reassembly": reassembly.OP11_SQL, "op12_centroids": clustering.OP12_SQL, "op13_decontamination": decontamination.OP13_SQL}
