"""Reads, joins, aggregation, ingestion, registry and retention over DataFrames."""
