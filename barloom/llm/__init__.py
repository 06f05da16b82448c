"""Training-data operators: quality, secrets, dedup, mixing, tokens, packing, archives."""
