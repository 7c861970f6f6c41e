"""Spark-native analytics for content-based recommendation."""
