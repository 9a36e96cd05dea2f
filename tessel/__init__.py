"""tessel: Spark-native statistics over models of heterogeneous records."""

__version__ = "0.1.0"
