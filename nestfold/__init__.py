"""nestfold: nested-JSON analytics on PySpark's DataFrame, SQL and streaming APIs."""

__version__ = "0.1.0"
