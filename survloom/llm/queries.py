"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from survloom.llm import bpe, jaccard, language, merkle, packing, privacy, quality, simhash, spelling, substrings, topk, toxicity, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_simhash": simhash.op2_simhash,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_privacy": privacy.op4_privacy,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_language": language.op6_language,
    "op7_maxscore": topk.op7_maxscore,
    "op8_warc": warc.op8_warc,
    "op9_quality": quality.op9_quality,
    "op10_substrings": substrings.op10_substrings,
    "op11_jaccard": jaccard.op11_jaccard,
    "op12_spelling": spelling.op12_spelling,
    "op13_merkle": merkle.op13_merkle,
}

ORACLES = {
    "op7_maxscore": topk.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op9_quality": quality.OP9_SQL,
    "op11_jaccard": jaccard.OP11_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
