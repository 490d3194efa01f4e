"""Streaming and OLAP SQL on PySpark: declarative query specifications, windows, corpora and data-quality operators."""

__version__ = "0.1.0"
