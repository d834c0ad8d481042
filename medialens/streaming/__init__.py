"""Structured Streaming: incremental ingest of landed API pages."""
