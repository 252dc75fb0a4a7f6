"""Operators for preparing training text: mixing, language identification, deduplication, sharding,
packing, chat formatting, quality rules and surrogates for personal data.

Nothing else in the library imports this subpackage.
"""
