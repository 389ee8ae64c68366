"""tallyforge: a Spark-native engine for checking, reconciling and selecting business records."""

__version__ = "0.1.0"
