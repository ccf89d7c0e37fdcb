"""Spark-native analytics for two-sided contests with market prices."""
