"""Training-data operators: near-duplicates, packing, mixing, scoring and search over documents."""
