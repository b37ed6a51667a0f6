"""Spark-first engine for document ingestion, retrieval and corpus processing."""
