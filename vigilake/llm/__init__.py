"""Operators for large training corpora: sharding, filtering, deduplication, mixing, search and tokenisation."""
