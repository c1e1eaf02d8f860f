"""Operators for preparing training data: deduplication, sharding, packing,
decontamination, toxicity and licence scans, archive fixity.

Nothing else in the library imports this package."""
