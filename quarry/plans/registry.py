"""All queries outside quarry.llm, by name."""

from __future__ import annotations

import importlib

MODULES: list[str] = ["scalar", "retrieval", "relational", "corpus", "validation", "intake", "structure", "streams", "runs", "plain", "analysis", "index_filter"]


def _all(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"quarry.plans.{m}"), name).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")


def flagship(spark, sf_dir):
    return queries()["retrieve_requests"](spark, sf_dir)
