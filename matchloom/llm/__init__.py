"""Training-data operators: corpus scans, deduplication, packing and tokenisation.

Nothing else in the library imports this subpackage.
"""
