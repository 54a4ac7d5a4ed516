"""All queries of the core package, by name."""

from __future__ import annotations

from spanloom.plans import claim_queries, eval_queries, label_queries, marker_queries, passage_queries, problems, publish_queries, score_queries, span_queries, text_queries

_MODULES = [problems, eval_queries, claim_queries, marker_queries, span_queries, text_queries, score_queries, passage_queries, publish_queries, label_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.oracle_sql().items()}
