"""Training-data operators: mixing, deduplication, filtering, extraction, pseudonyms.

Nothing outside this package imports it.
"""
