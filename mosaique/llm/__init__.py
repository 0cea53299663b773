"""Operators for preparing training text: quality, dedup, privacy, tokens, packing."""
