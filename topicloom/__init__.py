"""Spark-native multimodal topic analytics."""

__version__ = "0.1.0"
