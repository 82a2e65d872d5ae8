"""pairwright: set-at-a-time matching, ranking and evaluation on Spark DataFrames."""

__version__ = "0.1.0"
