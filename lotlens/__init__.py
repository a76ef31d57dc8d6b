"""Spark-native analytics over nested, revision-bearing tender tables."""
