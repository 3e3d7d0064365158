"""Structured Streaming variants of the event-time operators."""
