"""Spark-native analytics engine for subscription businesses."""

__version__ = "0.1.0"
