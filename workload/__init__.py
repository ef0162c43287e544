"""Registered queries over the given tables, by topic."""

from __future__ import annotations


def _load():
    from workload import (  # noqa: F401
        catalog_cases,
        edit_cases,
        feed_cases,
        language_cases,
        lexical_cases,
        media_cases,
        search_cases,
        vector_cases,
    )
    from workload import registry

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
