"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from lucidgraph.llm import bpe, embedding_dedup, exact_dedup, html_text, jaccard_join, language_id, license_scan, packing, substring_dedup, url_filter

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_ngram_jaccard": jaccard_join.op7_ngram_jaccard,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_url_filter": url_filter.op10_url_filter,
}

ORACLES = {
    "op3_embedding_dedup": embedding_dedup.OP3_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op7_ngram_jaccard": jaccard_join.OP7_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op9_license_scan": license_scan.OP9_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
}
