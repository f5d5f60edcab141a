"""The registered queries of the engine and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import composite_queries, entity_queries, eval_queries, graph_queries, hierarchy_queries, projection_queries, retrieval_queries, route_queries, source_queries, text_queries  # noqa: F401  they register themselves
from quarry.registry import ORACLE_SQL, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["t1_bm25_topk"](spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
