"""Spark-native short-string retrieval over collections of entries."""
