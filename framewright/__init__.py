"""framewright: Spark-native analytics for temporal-reuse and paired-run data."""

__version__ = "0.1.0"
