"""Training-data operators: dedup, filtering, tokenizing, packing, extraction."""
