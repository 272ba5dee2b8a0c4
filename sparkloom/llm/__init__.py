"""Training-data operators: deduplication, filtering, tokenisation and packing of document tables.

Nothing outside this subpackage imports it.
"""
