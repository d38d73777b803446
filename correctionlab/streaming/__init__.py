"""Structured Streaming forms of the learning loop."""
