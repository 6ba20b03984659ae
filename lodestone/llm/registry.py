"""Queries over the given tables: name -> function of (spark, folder), and the SQL for those that SQL can state."""

from __future__ import annotations

import importlib

MODULES = ["url_rules", "site_lines", "licenses", "simhash", "decontaminate", "packing", "quality", "language", "neighbours", "substrings", "ranked_search", "secret_scan", "negatives"]


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(importlib.import_module(f"lodestone.llm.{name}").QUERIES)
    return found


def oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found.update(importlib.import_module(f"lodestone.llm.{name}").ORACLES)
    return found
