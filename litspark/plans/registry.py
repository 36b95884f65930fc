"""Collects every registered query (importing the modules that register them)."""

from __future__ import annotations


def all_queries():
    from litspark.plans import queries, queries_files, queries_landed, queries_model, queries_nested, queries_places  # noqa: F401  (register on import)
    return dict(queries.REGISTRY)
