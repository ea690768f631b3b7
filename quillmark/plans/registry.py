"""All queries of the core with their SQL."""

from __future__ import annotations

from quillmark.plans import answer_views, audience, collect_views, decision_views, entity_views, graph, growth_views, merge_views, more_views, post_views, rollups, scalar_views, similarity_views, source_views, span_views, stream_views, text_views  # noqa: F401
from quillmark.plans.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
