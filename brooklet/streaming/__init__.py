"""Structured Streaming forms of ingest, de-duplication, daily counts and expiry."""
