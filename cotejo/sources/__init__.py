"""Readers of tables and record files, and sinks."""
