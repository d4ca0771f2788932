"""Registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from candlewick.llm import class_ngrams, fingerprint, langid, lexical_search, line_dedup, mixing, neighbours, packing, pii, quality, shingle_join, spelling, substring_dedup

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_nearest": neighbours.op2_nearest,
    "op3_pii": pii.op3_pii,
    "op4_quality": quality.op4_quality,
    "op5_mixing": mixing.op5_mixing,
    "op6_fingerprint": fingerprint.op6_fingerprint,
    "op7_packing": packing.op7_packing,
    "op8_language_id": langid.op8_language_id,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_ngram_jaccard": shingle_join.op10_ngram_jaccard,
    "op11_class_ngrams": class_ngrams.op11_class_ngrams,
    "op12_spelling": spelling.op12_spelling,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

#: the other operators cannot be said in SQL and are tested against brute force
ORACLE = {
    "op1_line_dedup": line_dedup.SQL,
    "op13_lexical_search": lexical_search.SQL,
}
