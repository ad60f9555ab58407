"""Spark-native retrieval and analytics over conversations and text corpora."""
