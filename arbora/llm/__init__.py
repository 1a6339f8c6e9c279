"""Training-data operators (WARC, deduplication, scoring, packing, token files).

Nothing else in the library imports this subpackage; ``queries`` registers its queries.
"""
