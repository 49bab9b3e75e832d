"""Spark-native corpus curation and retrieval evaluation."""
