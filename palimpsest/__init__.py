"""palimpsest: a Spark-native web-archive analytics engine."""

__version__ = "0.1.0"
