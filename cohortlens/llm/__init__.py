"""Operators for building text training data: encoding, extraction, near-duplicates, mixing, scoring, sharding."""
