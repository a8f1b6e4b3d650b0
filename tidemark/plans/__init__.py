"""Registered queries.  Importing the modules below fills the registry."""

from __future__ import annotations

from tidemark.plans.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    from tidemark.plans import chunk_queries, corpus_queries, qa_queries, result_queries, score_queries, stream_queries  # noqa: F401

    return dict(QUERIES)
