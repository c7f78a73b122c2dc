"""All queries of the subpackage, and the SQL of those that have any."""

from __future__ import annotations

import importlib

MODULES = [f"{__package__}.{m}" for m in ("token_counts", "jaccard_join", "decontaminate", "license_scan", "substring_dedup", "secret_scan", "pieces", "suffix_dedup", "quality", "fingerprints")]


def _collect(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(m), what)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")
