"""A repository-analytics engine whose operators are Spark plans."""

__version__ = "0.1.0"
