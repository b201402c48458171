"""Spark-native engine for versioned labelled property graphs."""

__version__ = "0.1.0"
