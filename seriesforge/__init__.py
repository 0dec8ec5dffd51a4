"""Spark-native analytics over many time series at once."""
