"""Training-data operators: mixing, deduplication, filtering, scans and formatting."""
