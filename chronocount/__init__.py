"""Spark-native analytics for time-stamped count matrices."""

__version__ = "0.1.0"
