"""Training-data operators: filters, near duplicates, mixing, sharding, tokens."""
