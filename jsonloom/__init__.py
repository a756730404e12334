"""A Spark-native JSON document engine: strict parsing, navigation and typed results as DataFrame operators."""

__version__ = "0.1.0"
