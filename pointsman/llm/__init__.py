"""Operators of a training-data pipeline: cleaning, deduplication, decontamination, sharding and packing of texts."""
