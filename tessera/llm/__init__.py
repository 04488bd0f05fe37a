"""Training-data operators: tokenising, sharding, filtering, deduplication and decontamination.

Nothing else in the library imports this subpackage.
"""
