"""A Spark engine for building and querying a cross-document fact base."""

__version__ = "0.1.0"
