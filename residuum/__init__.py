"""Residuum: footprint analytics over source trees, on Spark DataFrames."""

__version__ = "0.1.0"
