"""Training-data operators: packing, deduplication, search, scoring, tokenising and formatting."""
