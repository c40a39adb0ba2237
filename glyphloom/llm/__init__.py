"""Operators that prepare training data: search, extraction, filters, deduplication, packing.

Nothing else in the library imports this subpackage.
"""
