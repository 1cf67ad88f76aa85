"""Training-data operators: fingerprints, deduplication, filters, sharding, packing and scoring.

Nothing outside this subpackage imports it.
"""
