"""Structured Streaming forms of the change-tracking operators."""
