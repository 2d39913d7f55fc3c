"""Operators of a training-data pipeline: quality rules, deduplication, sanitising, encoding, packing, sharding.

Each module holds one operator with its general interface; ``queries`` applies
each to a whole table and derives the columns its contract names.
"""
