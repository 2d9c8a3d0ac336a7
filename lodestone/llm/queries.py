"""The queries of this subpackage, by name."""

from __future__ import annotations

from . import collocations, context_mixing, crf_language, cross_polytope, filter_audit, minhash_tensor, pfair_mix, pigeonhole_join, pii_offsets, repeats, secret_forest, stratified_shards, unigram_pieces

QUERIES = {
    "op1_pfair_mix": pfair_mix.op1_pfair_mix,
    "op2_secret_forest": secret_forest.op2_secret_forest,
    "op3_cross_polytope": cross_polytope.op3_cross_polytope,
    "op4_unigram_pieces": unigram_pieces.op4_unigram_pieces,
    "op5_pii": pii_offsets.op5_pii,
    "op6_context_mixing": context_mixing.op6_context_mixing,
    "op7_pigeonhole": pigeonhole_join.op7_pigeonhole,
    "op8_crf_language": crf_language.op8_crf_language,
    "op9_minhash": minhash_tensor.op9_minhash,
    "op10_repeats": repeats.op10_repeats,
    "op11_collocations": collocations.op11_collocations,
    "op12_stratified_shards": stratified_shards.op12_stratified_shards,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = {
    "op11_collocations": collocations.ORACLE,
    "op12_stratified_shards": stratified_shards.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}

