"""Structured Streaming over the change journal and the file catalogue."""
