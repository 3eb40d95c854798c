"""Operators for preparing training text: near-duplicates, filters, language, search, scoring, tokens, packing."""
