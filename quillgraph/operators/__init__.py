"""Graph maintenance, search, linkage, checks and evaluation on DataFrames."""
