"""Training-data operators: dedup, search, tokenising, classification, sharding."""
