"""Spark jobs for cleaning text corpora, retrieval over them, and the analytics around both."""
