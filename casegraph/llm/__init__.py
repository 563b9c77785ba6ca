"""Training-data operators: filtering, deduplication, mixing and formatting of large text corpora."""
