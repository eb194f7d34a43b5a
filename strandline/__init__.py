"""Spark-native analytics over code graphs, execution traces, hybrid retrieval and performance metrics."""
