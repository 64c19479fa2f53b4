"""Spark-native analytics for long-term conversational memory."""

__version__ = "0.1.0"
