"""Operators for preparing training text: cleaning, deduplication, formatting, tokens."""
