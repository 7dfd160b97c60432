"""Spark-native graph analytics and retrieval."""
