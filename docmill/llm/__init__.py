"""Training-data operators: packing, quality, archives, near-duplicates, sharding, mixing."""
