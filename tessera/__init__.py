"""A PySpark-native engine for near-duplicate detection over text and source code."""

__version__ = "0.1.0"
