"""One function per relation of the scorecard, each from DataFrames to a DataFrame."""
