"""Structured Streaming: continuous ingest and usage windows."""
