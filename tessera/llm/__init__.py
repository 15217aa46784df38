"""Training-data operators: scoring, filtering, deduplication, mixing, archives."""
