"""Incremental grading with Structured Streaming."""
