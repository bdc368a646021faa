"""Structured Streaming jobs over the drop folder and the store."""
