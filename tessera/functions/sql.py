"""The text and vector functions under names for SQL users, as SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions import text as T


def register(spark: SparkSession) -> None:
    """clean_text(text), doi_norm(doi), paper_id(name) and cosine(a, b). Spark puts their bodies in
    the place of a call, so they are optimised like built-in expressions."""
    clean = "text"
    for pattern, by in T.CLEANING:
        clean = f"regexp_replace({clean}, r'{pattern}', '{by}')"
    dot = "aggregate(zip_with({}, {}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    size = f"(sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')}))"
    bodies = {
        "clean_text(text STRING) RETURNS STRING": f"btrim({clean}, '{T.SPACES}')",
        "doi_norm(doi STRING) RETURNS STRING": f"regexp_replace(lower(btrim(doi, '{T.SPACES}')), r'\\.+$', '')",
        "paper_id(name STRING) RETURNS STRING": "substring(sha2(name, 256), 1, 12)",
        "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": f"CASE WHEN {size} > 0 THEN {dot.format('a', 'b')} / {size} ELSE 0D END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
