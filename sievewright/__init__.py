"""Spark-native multi-pattern text matching."""
