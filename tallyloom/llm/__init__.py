"""Training-data operators: tokenizing, deduplication, scoring, archives, mixing, sharding.

Nothing outside this subpackage imports it.
"""
