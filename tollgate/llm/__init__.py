"""Training-data operators: search, filters, deduplication, scrubbing, packing."""
