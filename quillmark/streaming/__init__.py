"""Structured Streaming forms of the burst operators."""
