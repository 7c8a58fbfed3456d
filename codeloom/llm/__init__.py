"""Training-data operators: deduplication, sharding, filtering, extraction, mixing, tokenizing, scoring."""
