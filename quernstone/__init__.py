"""Spark-native retrieval analytics: vector, lexical and hybrid search over DataFrames."""

__version__ = "0.1.0"
