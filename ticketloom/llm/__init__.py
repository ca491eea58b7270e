"""Training-data operators: filters, near-duplicate search, packing and scoring over document tables."""
