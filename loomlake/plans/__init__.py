"""Query plans: each module registers queries over the driver's tables with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.plans import catalog, chats, entitlements, logs, maintenance, retrieval, workflows  # isort: skip
from loomlake.plans import streams
from loomlake.plans.tables import load

__all__ = ["catalog", "chats", "entitlements", "flagship", "load", "logs", "maintenance", "retrieval", "streams", "workflows"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks, embedded, searched with each conversation's last user message, put together as context."""
    return retrieval.v5(spark, sf_dir).select("query_id", "agent_id", F.length("context").alias("context_chars"), "context")
