"""Versioned key-value analytics on Spark: an operation log folded into multi-version records."""

__version__ = "0.1.0"
