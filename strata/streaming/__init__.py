"""Structured Streaming over the event table."""
