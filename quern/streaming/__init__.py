"""Structured Streaming forms of routing, scoring, packing and resumable appends."""
