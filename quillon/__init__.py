"""quillon: feature construction and data preparation on Spark DataFrames."""

__version__ = "0.1.0"
