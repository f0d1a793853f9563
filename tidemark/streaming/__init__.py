"""Structured Streaming jobs over an event feed."""
