"""Incremental forms of the engine's aggregates."""
