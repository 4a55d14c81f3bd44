"""codeweft: a PySpark-native analytics engine for code graphs."""

__version__ = "0.1.0"
