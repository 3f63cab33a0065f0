"""Spark-native analytics engine for course documents, chunks, embeddings and curriculum data."""
