"""Spark-native analytics over match- and event-style tables."""
