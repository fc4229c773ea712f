"""Structured Streaming versions of what the batch operators keep."""
