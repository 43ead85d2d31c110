"""Operators for large text corpora: filters, near-duplicates, tokens, packing, sharding, fingerprints.

Nothing else in the library imports this subpackage.
"""
