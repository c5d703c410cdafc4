"""Spark-native analytics for satellite and weather series of single trees."""
