"""Structured Streaming forms of ingestion, roll-up and latest values."""
