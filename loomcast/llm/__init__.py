"""Operators for training-data pipelines: filtering, de-duplication, formatting, tokenising, packing, sharding."""
