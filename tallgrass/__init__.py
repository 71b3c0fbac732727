"""Spark-native detection rules, event analytics and corpus preparation."""
