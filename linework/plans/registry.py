"""Registered queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linework.plans import document_queries, file_queries, line_queries, stream_queries, table_queries

MODULES = [line_queries, file_queries, table_queries, document_queries, stream_queries]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a word per document."""
    return line_queries.hits_per_document(spark, sf_dir)
