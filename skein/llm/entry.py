"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bloomlm, bytebpe, curriculum, langid, ngramjoin, oggmedia, quality, residuegemm, spotsigs, suffixdedup, termpipeline, toxicity, windowdedup

QUERIES = {
    "op7_log_bloom_lm": bloomlm.op7_log_bloom_lm,
    "op9_induced_suffix_dedup": suffixdedup.op9_induced_suffix_dedup,
    "op8_adaptive_prefix_join": ngramjoin.op8_adaptive_prefix_join,
    "op1_spot_signatures": spotsigs.op1_spot_signatures,
    "op10_marginal_langid": langid.op10_marginal_langid,
    "op5_two_tier_bpe": bytebpe.op5_two_tier_bpe,
    "op2_byte_conv_quality": quality.op2_byte_conv_quality,
    "op6_factorization_toxicity": toxicity.op6_factorization_toxicity,
    "op3_ogg_media": oggmedia.op3_ogg_media,
    "op4_curriculum_mix": curriculum.op4_curriculum_mix,
    "op11_residue_negatives": residuegemm.op11_residue_negatives,
    "op12_rabin_karp_windows": windowdedup.op12_rabin_karp_windows,
    "op13_pipelined_term_search": termpipeline.op13_pipelined_term_search,
}
SQL = {
    "op4_curriculum_mix": curriculum.OP4_SQL,
    "op8_adaptive_prefix_join": ngramjoin.OP8_SQL,
    "op9_induced_suffix_dedup": suffixdedup.OP9_SQL,
    "op11_residue_negatives": residuegemm.OP11_SQL,
    "op12_rabin_karp_windows": windowdedup.OP12_SQL,
    "op13_pipelined_term_search": termpipeline.OP13_SQL,
}
