"""Structured Streaming over files and events."""
