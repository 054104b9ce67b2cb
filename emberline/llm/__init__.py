"""Training-data operators: search, formatting, packing, filtering, sharding, tokenizing and dedup."""
