"""qalam: Spark-native preparation and auditing of Arabic training text."""

__version__ = "0.1.0"
