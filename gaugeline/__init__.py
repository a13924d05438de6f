"""Spark-native quality control for large panels of numeric observations."""

__version__ = "0.1.0"
