"""koengine: a PySpark-native analytics engine over versioned knowledge objects."""

__version__ = "0.1.0"
