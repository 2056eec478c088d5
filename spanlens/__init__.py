"""spanlens: span analytics (call graphs, trees, contracts, sessions, reports) as Spark DataFrame jobs."""

__version__ = "0.1.0"
