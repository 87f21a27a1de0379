"""Spark-native analytics over Gaussian-splat scenes kept as tables."""
