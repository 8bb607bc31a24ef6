"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

MODULES = ("mixing", "hamming", "token_store", "quality", "license_scan", "token_counts", "ngram_join", "nearest", "language_id", "bpe", "vector_codes", "ranked_search", "decontamination")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"quarry.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"quarry.llm.{m}").ORACLE.items()}
