"""Metadata, code-graph, search and training-data analytics on PySpark."""
