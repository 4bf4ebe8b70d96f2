"""leafmill: a PySpark-native analytics engine for processed documents."""

__version__ = "0.1.0"
