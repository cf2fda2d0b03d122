"""Spark-native analytics for mountain-hazard monitoring data."""
