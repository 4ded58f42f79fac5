"""Spark-native engine for measuring how word meanings move through dated text."""

__version__ = "0.1.0"
