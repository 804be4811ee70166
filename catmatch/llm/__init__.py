"""Operators for training-data corpora: formatting, filtering, deduplication, mixing, packing and search."""
