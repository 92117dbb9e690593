"""Structured Streaming forms of the token fold and of ingestion progress."""
