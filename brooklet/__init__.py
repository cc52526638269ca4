"""Brooklet: a Spark-native text-memory analytics engine."""
