"""Operators that prepare training text: packing, extraction, search, filters, deduplication, mixing."""
