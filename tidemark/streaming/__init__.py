"""Structured Streaming: ingest into versions, windowed counts, deduplication, ranked state."""
