"""Spark-native operators for recorded two-party conversations and the logs around them."""

__version__ = "0.1.0"
