"""Structured-memory retrieval and training-data preparation on Spark."""
