"""Data engine for parallel text-simplification corpora, on Spark DataFrames."""
