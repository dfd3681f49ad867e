"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from tessella.llm import html_text, mixing, nearest, ngram_join, pieces, quality, substring, suffix_dedup, token_files, toxicity
from tessella.llm.oracles import ORACLE_SQL

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_mixing_sources": mixing.op2_mixing_sources,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_html_extraction": html_text.op6_html_extraction,
    "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_nearest_neighbours": nearest.op9_nearest_neighbours,
    "op10_token_files": token_files.op10_token_files,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
