"""Operators of a training-data pipeline: scoring, filtering, extraction, search, mixing, deduplication and packing.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
