"""Operators that prepare training text: counting, cleaning, dedup, extraction, sharding and packing."""
