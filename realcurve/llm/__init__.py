"""Operators that prepare training data: fingerprints, scores, mixtures, encodings, joins, filters, extraction, packing."""
