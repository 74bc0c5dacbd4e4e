"""Spark-native lecture evidence analytics."""
