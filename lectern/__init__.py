"""Spark-native document preparation, storage, retrieval and question answering."""
