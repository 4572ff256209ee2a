"""Company fundamentals as Spark DataFrames: facts, checks, analytics, forecasts and lineage for many companies at once."""

__version__ = "0.1.0"
