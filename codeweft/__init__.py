"""codeweft: a Spark-native engine for code knowledge graphs and training-data tables."""

__version__ = "0.1.0"
