"""Spark-native analytics for highly multiplexed tissue imaging."""
