"""Structured Streaming jobs over the scored mail log."""
