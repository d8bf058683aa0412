"""Span and token analytics on PySpark."""
