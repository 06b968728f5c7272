"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from . import chat, decontamination, divergence, fingerprints, lines, near_dup, packing, quality, repeats, sharding, token_store, toxicity, whitening


def queries() -> dict:
    return {
        "op1_chat_snapshots": chat.op1_chat_snapshots,
        "op2_multiset_fingerprints": fingerprints.op2_multiset_fingerprints,
        "op3_quality_vote": quality.op3_quality_vote,
        "op4_toxicity_fm": toxicity.op4_toxicity_fm,
        "op5_run_length_index": repeats.op5_run_length_index,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_line_dedup": lines.op7_line_dedup,
        "op8_benchmark_leaks": decontamination.op8_benchmark_leaks,
        "op9_token_store": token_store.op9_token_store,
        "op10_bagminhash": near_dup.op10_bagminhash,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_hilbert_shards": sharding.op13_hilbert_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_snapshots": chat.OP1_SQL, "op7_line_dedup": lines.OP7_SQL, "op12_source_divergence": divergence.OP12_SQL}
