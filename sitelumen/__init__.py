"""Spark-native audit and scoring engine for captured web pages."""

__version__ = "0.1.0"
