"""Operators for building training corpora: dedup, filtering, mixing, sharding and packing."""
