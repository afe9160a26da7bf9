"""Spark-native analytics and mining engine."""
