"""Training-data operators: sharding, token counts, deduplication, quality, extraction and search.

Nothing else in the library imports this subpackage.
"""
