"""Inkstone: a Spark-native engine for cross-document text analytics."""

__version__ = "0.1.0"
