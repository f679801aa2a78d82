"""entrack: entity retrieval and event tracking on Spark DataFrames."""

__version__ = "0.1.0"
