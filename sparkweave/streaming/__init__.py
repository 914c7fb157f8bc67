"""Incremental ingest with Structured Streaming: the same chunking, over a stream of section files."""
