"""Spark-native product search, recommendation and event analytics."""
