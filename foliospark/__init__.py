"""Spark-native text datamart, retrieval and benchmark-analytics engine."""
