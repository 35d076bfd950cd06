"""Training-data operators: deduplication, filters, search, tokenising and packing of text corpora.

Nothing else in the library imports this subpackage.
"""
