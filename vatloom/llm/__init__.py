"""Training-data operators: deduplication, filtering, formatting, mixing and scoring of document corpora.

Nothing outside this subpackage imports it.
"""
