"""Training-data operators: formatting, scoring, deduplication, extraction and packing."""
