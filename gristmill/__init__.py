"""Spark-native product search, text analytics and data preparation."""

__version__ = "0.1.0"
