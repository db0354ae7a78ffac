"""Spark-native processing of financial statement documents."""

__version__ = "0.1.0"
