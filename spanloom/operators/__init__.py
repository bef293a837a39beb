"""DataFrames in, DataFrames out."""
