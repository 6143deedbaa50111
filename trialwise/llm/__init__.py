"""Training-data operators: counting, encoding, scanning, deduplication, mixing, filtering and sharding.

Nothing else in the library imports this subpackage.
"""
