"""The subpackage's queries and their SQL twins."""

from __future__ import annotations

import corpus_pipeline

from . import exact_dedup, fingerprints, language_id, line_dedup, mixing, ngram_join, pii, sentencepiece_codec, suffix_dedup, url_filter

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op2_ngram_jaccard": ngram_join.SQL,
    "op6_url_filter": url_filter.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
