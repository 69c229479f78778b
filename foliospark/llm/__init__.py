"""Operators of a training-data pipeline: filters, deduplication, packing, sharding.

Nothing outside this subpackage imports it.
"""
