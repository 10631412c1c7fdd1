"""Structured Streaming: orders as they arrive."""
