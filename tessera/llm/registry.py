"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from tessera.llm import ann, lm, near_vectors, ngram_join, packing, pieces, suffix_dedup, tokenfile, toxicity, urlfilter

QUERIES = {
    "op1_ngram_join": ngram_join.ngram_join_query,
    "op2_pieces": pieces.pieces_query,
    "op3_near_vectors": near_vectors.near_vectors_query,
    "op4_toxicity": toxicity.toxicity_query,
    "op5_url_filters": urlfilter.url_filter_query,
    "op6_suffix_dedup": suffix_dedup.suffix_dedup_query,
    "op7_token_ids": tokenfile.token_ids_query,
    "op8_packing": packing.packing_query,
    "op9_lm_scores": lm.lm_query,
    "op10_nearest": ann.nearest_query,
}

ORACLE_SQL = {
    "op5_url_filters": urlfilter.URL_FILTER_SQL,
}
