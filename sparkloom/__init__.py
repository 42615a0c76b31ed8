"""Spark-native retrieval, conversation analytics and corpus preparation."""
