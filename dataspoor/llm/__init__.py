"""Training-data operators: dedup, language, quality, sharding, tokens, packing, search."""
