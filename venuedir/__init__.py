"""Spark-native operators for catalogues of academic journals and conferences."""

__version__ = "0.1.0"
