"""Structured Streaming versions of the batch workflows."""
