"""Marginalia: retrieval-corpus processing as Spark DataFrame jobs."""
