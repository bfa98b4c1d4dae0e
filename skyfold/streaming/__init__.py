"""Incremental catalogue ingest with Structured Streaming."""
