"""Training-data operators: packing, deduplication, filtering, tokenising and sharding of document tables.

Nothing outside this subpackage imports it.
"""
