"""Spark-native analytics over code-intelligence tables."""

__version__ = "0.1.0"
