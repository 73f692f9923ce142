"""Versioned entity and component data on Spark: logs, views, a small query language and domain operators."""

__version__ = "0.1.0"
