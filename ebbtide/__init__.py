"""Customer churn analysis and response targeting on Spark DataFrames."""

__version__ = "0.1.0"
