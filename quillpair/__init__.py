"""Spark-native analytics engine for pairs of short texts."""
