"""Analytics and maintenance of multi-tenant lake tables on Spark."""

__version__ = "0.1.0"
