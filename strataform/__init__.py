"""Spark-native fact tables, typed queries and training-data operators over repositories and claim stores."""

__version__ = "0.1.0"
