"""Structured Streaming forms of the merge operators."""
