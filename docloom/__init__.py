"""docloom: Spark analytics over repository changes, documents and run logs."""

__version__ = "0.1.0"
