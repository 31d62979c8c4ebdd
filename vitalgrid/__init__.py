"""Spark-native engine for public-health event tables, fact cubes and typed fields."""

__version__ = "0.1.0"
