"""Embedding-space migration and retrieval-quality analytics on Spark."""
