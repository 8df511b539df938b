"""Spark-native analytics for adaptive web crawls: DataFrame in, DataFrame out."""

__version__ = "0.1.0"
