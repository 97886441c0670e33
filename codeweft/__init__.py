"""Spark-native analytics over code knowledge graphs."""
