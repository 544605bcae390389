"""Structured Streaming entry points (incremental prep of wide exports)."""
