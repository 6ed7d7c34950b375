"""Operators for preparing training data: search, near-duplicates, tokens, scoring, selection and packing."""
