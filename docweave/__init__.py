"""Document analytics and retrieval on PySpark."""

__version__ = "0.1.0"
