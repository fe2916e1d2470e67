"""The queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from foretide.llm import decontaminate, exact_dedup, lexical, licences, lz_dedup, mixing, pii, quality, sharding, simhash, suffix_dedup, tokens, whitening

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op10_token_output": tokens.op10_token_output,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_pii": pii.op12_pii,
    "op13_whitening": whitening.op13_whitening,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality": quality.op5_quality,
    "op6_mixing": mixing.op6_mixing,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_lz_dedup": lz_dedup.op8_lz_dedup,
    "op9_licence_scan": licences.op9_licence_scan,
}
ORACLE_SQL = {
    "op11_lexical_search": lexical.OP11_SQL,
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op8_lz_dedup": lz_dedup.OP8_SQL,
    "op9_licence_scan": licences.OP9_SQL,
}
