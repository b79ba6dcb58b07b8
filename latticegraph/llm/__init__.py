"""Training-data operators: deduplication, filtering, tokenization, sharding, WARC and HTML.

Nothing else in the library imports this subpackage.
"""
