"""Training-data operators: scoring, deduplication, tokenising, privacy, extraction and packing of text corpora.

Nothing else in the library imports this subpackage.
"""
