"""Operators over training text and very large numeric columns."""
