"""Dataset operators: splitting, sharding, merging, coverage, selection, review, training records."""
