"""Training-data operators: deduplication, packing, sharding, extraction and so on.

Nothing outside this subpackage imports it. ``queries.py`` registers the
thin ``opN_*`` queries over the operators of the other modules.
"""
