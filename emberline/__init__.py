"""Emberline: Spark-native analytics over repair histories, session logs and their text, vectors and graphs."""

__version__ = "0.1.0"
