"""Training-data operators: quality, search, sharding, tokenising, extraction, dedup, mixing, media, ordering.

Nothing outside this folder imports it.
"""
