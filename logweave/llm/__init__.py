"""Operators for preparing training data at corpus scale (fingerprints, packing,
cleaning, sharding, similarity joins, chat formatting, pseudonyms, token files).

Nothing else in the library imports this package.
"""
