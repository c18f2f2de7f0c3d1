"""brindle: a Spark-native engine for querying logs and for preparing log and text tables."""

__version__ = "0.1.0"
