"""Spark-native text search, catalogue and question-log analytics."""
