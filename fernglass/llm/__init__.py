"""Training-data operators: extraction, deduplication, fingerprints, mixing, packing, token output."""
