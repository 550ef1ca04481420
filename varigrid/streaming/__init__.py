"""Ordered-stream processing as Structured Streaming."""
