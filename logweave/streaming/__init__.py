"""Structured Streaming forms of ingest, timeline, embedding and alerting."""
