"""Operators for preparing training data: rules, deduplication, mixing, packing, token files, archives, search, scores."""
