"""Training-data operators: language, quality, deduplication, search, mixing and packing."""
