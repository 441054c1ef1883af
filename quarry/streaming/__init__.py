"""Structured Streaming forms of ingestion and trace analytics."""
