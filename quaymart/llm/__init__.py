"""Operators for training-data pipelines: documents, vectors and token files."""
