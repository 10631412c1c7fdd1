"""Operators for building training data: search, deduplication, filtering,
scoring and mixing of documents. Nothing else in the library imports this
subpackage."""
