"""Operators of a training-data pipeline: duplicates, filters, fingerprints, mixing and tokens."""
