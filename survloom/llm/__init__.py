"""Training-data operators: packing, deduplication, classifiers, privacy, tokens, search, archives."""
