"""Training-data operators: scoring, packing, deduplication, filtering, extraction.

Nothing else in the library imports this subpackage.
"""
