"""quantflume: market-state analytics on ordered bar data, built on Spark DataFrames."""

__version__ = "0.1.0"
