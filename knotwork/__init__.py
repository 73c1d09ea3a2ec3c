"""Property-graph knowledge analytics on Spark DataFrames."""

from knotwork.model import Graph

__all__ = ["Graph"]
