"""Structured Streaming forms of ingest and daily aggregation."""
