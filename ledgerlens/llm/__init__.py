"""Operators for building training corpora: near-duplicates, filters, scans, packing, sharding.

Nothing outside this package imports it. ``QUERIES`` holds the registered queries.
"""
