"""Registered queries, grouped by topic."""

import importlib

TOPICS = ["ingest", "retrieval", "grounding", "understanding", "tables", "operations"]


def load_all() -> None:
    for topic in TOPICS:
        importlib.import_module(f"lodestone.plans.{topic}")
