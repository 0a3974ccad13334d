"""Millrace: retrieval analytics and data processing as PySpark DataFrame operators."""

__version__ = "0.1.0"
