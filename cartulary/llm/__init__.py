"""Operators for preparing training data: cleaning, deduplication, scoring, mixing and encoding."""
