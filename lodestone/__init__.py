"""Lodestone: a Spark-native engine for geocoded features and training-data pipelines."""

__version__ = "0.1.0"
