"""Operators for preparing training data: counting, packing, deduplication, mixing, sharding, filtering, classification, archives."""
