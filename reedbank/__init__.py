"""PySpark-native engine for amplicon placement analytics."""

__version__ = "0.1.0"
