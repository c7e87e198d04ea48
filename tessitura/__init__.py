"""Spark-native analytics for media catalogs, timed text and play history."""
