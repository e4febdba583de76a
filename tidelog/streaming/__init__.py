"""Structured Streaming into a table."""
