"""Structured Streaming: incremental ingest of landed report files."""
