"""Spark-native engine for retrieval, recommendation and record work over tabular catalogues."""
