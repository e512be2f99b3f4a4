"""Structured Streaming forms of the windowed counts, clustering and next-event scoring."""
