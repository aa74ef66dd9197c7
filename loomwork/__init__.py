"""Feature engineering, statistics and machine learning stages for Spark DataFrames."""

__version__ = "0.1.0"
