"""Training-data operators: mixing, archives, language, fingerprints, filters, packing, quality and duplicates."""
