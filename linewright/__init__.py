"""Spark-first text extraction and evaluation engine."""
