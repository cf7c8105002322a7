"""tessera: a Spark-native engine for customer master data (match, merge, score, report)."""

__version__ = "0.1.0"
