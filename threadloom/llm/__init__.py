"""Operators of a training-data pipeline: cleaning, dedup, mixing, sharding, search, tokens.

Nothing else in the library imports this package.
"""
