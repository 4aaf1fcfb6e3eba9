"""Retrieval-evaluation analytics on Spark."""
