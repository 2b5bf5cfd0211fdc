"""Operators of a training-data pipeline: filters, fingerprints, sharding, tokens, mixing, dedup."""
