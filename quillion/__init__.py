"""Quillion: a Spark-first engine for literature retrieval and structured evidence."""
