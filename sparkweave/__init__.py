"""Spark-first engine for hybrid (vector + typed graph) document retrieval."""

__version__ = "0.1.0"
