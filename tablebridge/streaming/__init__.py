"""Structured Streaming form of the change apply."""
