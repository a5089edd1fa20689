"""Structured Streaming versions of ingest and monitoring."""
