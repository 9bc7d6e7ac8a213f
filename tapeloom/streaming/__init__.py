"""Structured Streaming forms of the tick operators."""
