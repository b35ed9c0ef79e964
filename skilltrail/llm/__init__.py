"""Operators for training-data pipelines: sharding, packing, extraction, filters, near copies."""
