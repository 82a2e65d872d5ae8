"""Event roll-ups that run the same on batch and streaming DataFrames."""
