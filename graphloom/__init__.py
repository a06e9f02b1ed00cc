"""Spark-native graph-retrieval analytics."""
