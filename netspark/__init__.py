"""Matrix-to-network analytics on PySpark."""

__version__ = "0.1.0"
