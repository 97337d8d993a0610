"""Declared record files: layouts, reading, validation by rules, completion and writing."""
