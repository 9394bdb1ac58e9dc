"""Structured Streaming over append-only logs."""
