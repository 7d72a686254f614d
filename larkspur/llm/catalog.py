"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from larkspur.llm import bench_windows, collision_vectors, collocations, feistel_pii, lexicon_toxicity, line_dedup, ngram_join, pfair_mix, piece_lattice, quality_rules, slot_sharding, style_tree, vector_codes

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_style_tree": style_tree.op3_style_tree,
    "op4_pfair_mix": pfair_mix.op4_pfair_mix,
    "op5_piece_lattice": piece_lattice.op5_piece_lattice,
    "op6_lexicon_toxicity": lexicon_toxicity.op6_lexicon_toxicity,
    "op7_collision_vectors": collision_vectors.op7_collision_vectors,
    "op8_feistel_pii": feistel_pii.op8_feistel_pii,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_slot_sharding": slot_sharding.op10_slot_sharding,
    "op11_bench_windows": bench_windows.op11_bench_windows,
    "op12_collocations": collocations.op12_collocations,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op4_pfair_mix": pfair_mix.ORACLE,
    "op7_collision_vectors": collision_vectors.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
    "op11_bench_windows": bench_windows.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
