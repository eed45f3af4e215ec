"""The driver queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import chat, decontaminate, jaccard, lmscore, mixing, quality, shards, tokencounts, tokenfiles, urlfilter

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_mixing": mixing.op2_mixing,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_tokencounts": tokencounts.op4_tokencounts,
    "op5_lmscore": lmscore.op5_lmscore,
    "op6_chat": chat.op6_chat,
    "op7_sharding": shards.op7_sharding,
    "op8_quality": quality.op8_quality,
    "op9_urlfilter": urlfilter.op9_urlfilter,
    "op10_tokenfiles": tokenfiles.op10_tokenfiles,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op3_jaccard": jaccard.ORACLE,
    "op6_chat": chat.ORACLE,
    "op7_sharding": shards.ORACLE,
    "op8_quality": quality.ORACLE,
    "op9_urlfilter": urlfilter.ORACLE,
}
