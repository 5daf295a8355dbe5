"""Compare, patch and merge keyed tables with Spark."""

__version__ = "0.1.0"
