"""Structured Streaming forms of the state and week operators."""
