"""All named queries with their SQL twins."""
from catmatch.plans import (  # noqa: F401
    activity_queries, catalog_queries, decision_queries, projection_queries, relational_queries, text_queries,
    streaming_queries, vector_queries)
from catmatch.plans.registry import ORACLES, QUERIES, SURVEY_IDS  # noqa: F401
