"""Postmill: curation and analytics of posting streams on Spark."""

__version__ = "0.1.0"
