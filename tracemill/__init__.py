"""tracemill: Spark-native processing of retrieval-agent training data."""

__version__ = "0.1.0"
