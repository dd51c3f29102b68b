"""The queries of this subpackage: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

from litspark.llm import (bin_packing, centroids, chat_format, decontaminate, exact_dedup, html_extract, lexical_search, lm_score,
                          near_dedup, packing, pii, quality, toxicity)

QUERIES = {
    "op6_exact_dedup": (exact_dedup.query, exact_dedup.SQL),
    "op9_near_dedup": (near_dedup.query, near_dedup.SQL),
    "op3_decontaminate": (decontaminate.query, decontaminate.SQL),
    "op4_packing": (packing.query, packing.SQL),
    "op5_quality": (quality.query, quality.SQL),
    "op7_toxicity": (toxicity.query, toxicity.SQL),
    "op8_lm_score": (lm_score.query, lm_score.SQL),
    "op10_chat_format": (chat_format.query, chat_format.SQL),
    "op1_pii": (pii.query, pii.SQL),
    "op11_best_fit": (bin_packing.query, bin_packing.SQL),
    "op12_lexical_search": (lexical_search.query, lexical_search.SQL),
    "op13_centroids": (centroids.query, centroids.SQL),
    "op2_html_extract": (html_extract.query, html_extract.SQL),
}
