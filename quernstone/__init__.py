"""quernstone: a Spark-native engine for web-content retrieval pipelines."""

__version__ = "0.1.0"
