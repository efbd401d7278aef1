"""quillon: vector search and mutation-log analytics on Spark DataFrames."""

__version__ = "0.1.0"
