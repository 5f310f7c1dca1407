"""loomshift: a PySpark-native relational and key-value analytics engine."""

__version__ = "0.1.0"
