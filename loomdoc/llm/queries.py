"""Queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from loomdoc.llm import embedding_dedup, fill_in_middle, language_id, lexical_search, license_scan, lm_scoring, media_columns, mixing, ngram_jaccard, piece_codec, quality, token_counts, url_filters

QUERIES = {
    "op1_sentencepiece": piece_codec.op1_sentencepiece,
    "op2_media_columns": media_columns.op2_media_columns,
    "op3_language_id": language_id.op3_language_id,
    "op4_quality": quality.op4_quality,
    "op5_ngram_jaccard": ngram_jaccard.op5_ngram_jaccard,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_mixing": mixing.op9_mixing,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_ranked_search": lexical_search.op12_ranked_search,
    "op13_lm_scores": lm_scoring.op13_lm_scores,
}

ORACLE_SQL = {"op7_url_filters": url_filters.oracle_sql(), "op11_fill_in_middle": fill_in_middle.oracle_sql(), "op12_ranked_search": lexical_search.oracle_sql()}
