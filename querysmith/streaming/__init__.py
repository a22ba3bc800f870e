"""Structured Streaming variants of the roll-ups."""
