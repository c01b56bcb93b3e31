"""Structured Streaming forms of the monitoring programs."""
