"""Tessera: a Spark-first document retrieval and corpus processing engine."""
