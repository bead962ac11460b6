"""Spark-native analytics for stacked spatial observations and time series."""
