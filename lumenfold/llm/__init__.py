"""Training-data operators: packing, filters, deduplication, search, fingerprints, mixing."""
