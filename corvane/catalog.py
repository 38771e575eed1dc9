"""All queries over the driver tables, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.plans import chunk_queries, chunker_queries, event_queries, generation_queries, guard_queries, prompt_queries, retrieval_queries, store_queries, text_queries, vector_queries  # noqa: F401  they register their queries
from corvane.plans.registry import ORACLE_SQL, QUERIES, Tables

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked, budgeted context for the questions of ``benchmark``."""
    return retrieval_queries.ranked_context(Tables(spark, sf_dir))
