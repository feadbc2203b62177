"""Structured Streaming versions of the continuous parts."""
