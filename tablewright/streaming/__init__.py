"""Incremental harmonisation on Structured Streaming."""
