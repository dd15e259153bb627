"""mailmine: Spark-native mining of reusable message patterns."""

__version__ = "0.1.0"
