"""Structured Streaming forms of the inbox and the queue."""
