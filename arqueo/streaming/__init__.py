"""Structured Streaming over append-only tables."""
