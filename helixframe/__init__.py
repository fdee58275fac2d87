"""Spark-native analytics over site x sample tables."""
