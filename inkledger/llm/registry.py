"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import conversations, decontamination, licences, merkle, mixing, passages, private, quality, sharding, simhash, tokens, vectors, warc

QUERIES = {
    "op1_factorisation_machine": quality.op1_factorisation_machine,
    "op2_suffix_decontamination": decontamination.op2_suffix_decontamination,
    "op3_sentence_spans": passages.op3_sentence_spans,
    "op4_simhash_tiles": simhash.op4_simhash_tiles,
    "op5_token_attribution": tokens.op5_token_attribution,
    "op6_sorted_projections": vectors.op6_sorted_projections,
    "op7_licence_rules": licences.op7_licence_rules,
    "op8_feistel_pseudonyms": private.op8_feistel_pseudonyms,
    "op9_curriculum_mix": mixing.op9_curriculum_mix,
    "op10_rendezvous_shards": sharding.op10_rendezvous_shards,
    "op11_warc_chains": warc.op11_warc_chains,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLES = {
    "op2_suffix_decontamination": decontamination.OP2_SQL,
    "op3_sentence_spans": passages.OP3_SQL,
    "op6_sorted_projections": vectors.OP6_SQL,
    "op9_curriculum_mix": mixing.OP9_SQL,
    "op11_warc_chains": warc.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_conversation_repair": conversations.OP13_SQL,
}
