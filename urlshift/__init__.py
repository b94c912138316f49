"""Bulk domain migration for blog-network databases, built from Spark DataFrame operations."""

__version__ = "0.1.0"
