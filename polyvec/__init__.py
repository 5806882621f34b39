"""Spark-native multi-vector retrieval, ranking and evaluation."""
