"""All registered queries."""

from runtime_insights.plans import (  # noqa: F401
    ingest_queries, metric_queries, profile_queries, semantic_queries,
)
from runtime_insights.plans.base import QUERIES, TWINS  # noqa: F401
