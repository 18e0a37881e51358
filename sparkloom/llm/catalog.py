"""The queries of this subpackage, each over the whole of its table, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, embedding_dedup, exact_topk, language, mixing, ngram_join, pii, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_language": language.op1_language,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_exact_topk": exact_topk.op7_exact_topk,
    "op8_pii": pii.op8_pii,
    "op9_mix": mixing.op9_mix,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}

ORACLES = {
    "op4_embedding_dedup": embedding_dedup.OP4_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op7_exact_topk": exact_topk.OP7_SQL,
    "op9_mix": mixing.OP9_SQL,
    "op10_ngram_join": ngram_join.OP10_SQL,
}
