"""Spark-native analytics for controlled cause-effect corpora."""

__version__ = "0.1.0"
