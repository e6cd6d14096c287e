"""Structured Streaming jobs that reuse the batch expressions."""
