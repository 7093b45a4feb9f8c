"""Structured Streaming forms of catalogue ingest and run checks."""
