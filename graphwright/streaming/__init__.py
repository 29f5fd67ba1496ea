"""Structured Streaming jobs for the stateful parts (running statistics,
first-seen concepts, incremental graph ingest)."""
