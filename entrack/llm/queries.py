"""The registered opN queries."""

from __future__ import annotations

from entrack.llm import decontamination, lattice_lm, line_dedup, merkle_manifest, minhash_forest, mixing, packing, pii_surrogates, secrets_scan, token_alignment, token_counts, topk_search, toxicity

QUERIES = {
    "op3_pii_surrogates": pii_surrogates.op3_pii_surrogates,
    "op2_toxicity": toxicity.op2_toxicity,
    "op5_lattice_lm": lattice_lm.op5_lattice_lm,
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op7_secret_scan": secrets_scan.op7_secret_scan,
    "op6_decontamination": decontamination.op6_decontamination,
    "op8_minhash_forest": minhash_forest.op8_minhash_forest,
    "op4_packing": packing.op4_packing,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_topk_search": topk_search.op10_topk_search,
    "op11_mixing": mixing.op11_mixing,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}
ORACLES = {
    "op8_minhash_forest": minhash_forest.ORACLE_SQL,
    "op10_topk_search": topk_search.ORACLE_SQL,
    "op11_mixing": mixing.ORACLE_SQL,
    "op13_merkle_manifest": merkle_manifest.ORACLE_SQL,
}
