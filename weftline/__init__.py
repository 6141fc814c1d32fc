"""Spark-native analytics over tables of records and documents."""

__version__ = "0.1.0"
