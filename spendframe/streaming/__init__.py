"""Structured Streaming twins of the batch ingest."""
