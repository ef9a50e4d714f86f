"""Spark-native analytics over structured document knowledge."""
