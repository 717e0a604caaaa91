"""Spark-native analytics over property graphs kept as two DataFrames (nodes and edges)."""
