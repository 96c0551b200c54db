"""Operators for training data: cleaning, deduplication, scoring, tokenising and storage of texts."""
