"""Query bindings: every operator run on the given tables."""

from __future__ import annotations

import importlib

AREAS = ("comments", "posts", "statistics", "monitoring", "accounts", "corpus", "ingest", "streams",
         "measures", "words")


def all_queries():
    from tidemark.plans import registry

    for area in AREAS:
        importlib.import_module(f"tidemark.plans.{area}")
    return registry.QUERIES, registry.ORACLE
