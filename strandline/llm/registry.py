"""Queries and SQL of this subpackage, by the names the entry point uses."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_toxicity": "toxicity",
    "op2_chat_formatting": "chat_format",
    "op3_embedding_near_dedup": "embedding_dedup",
    "op4_ngram_jaccard_join": "jaccard_join",
    "op5_line_dedup": "line_dedup",
    "op6_bpe_codec": "bpe_codec",
    "op7_best_fit_packing": "packing",
    "op8_license_scan": "license_scan",
    "op9_suffix_array_dedup": "suffix_dedup",
    "op10_exact_dedup": "exact_dedup",
    "op11_cross_tokenizer_alignment": "cross_tokenizer",
    "op12_document_fingerprints": "fingerprints",
    "op13_centroid_clustering": "centroid_clustering",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{_MODULES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in _MODULES if (sql := getattr(_module(name), "SQL", None))}
