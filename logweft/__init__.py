"""Spark-native analytics over server and request logs."""
