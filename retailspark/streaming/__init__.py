"""Structured Streaming twins of the ingest operators."""
