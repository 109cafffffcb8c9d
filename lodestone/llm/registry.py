"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontamination, line_dedup, media, mixing, repair, sharding, simhash, spelling, substring, token_counts, toxicity, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_sharding": sharding.op3_sharding,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_warc": warc.op5_warc,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_chat": chat.op7_chat,
    "op8_mixing": mixing.op8_mixing,
    "op9_simhash_near_dup": simhash.op9_simhash_near_dup,
    "op10_media": media.op10_media,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_substring_dedup": substring.op13_substring_dedup,
}
ORACLES: dict[str, str] = {"op3_sharding": sharding.ORACLE, "op5_warc": warc.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op7_chat": chat.ORACLE}
