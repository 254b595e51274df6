"""Training-data operators: scans, deduplication, sampling, mixing and packing.

Nothing else in the library imports this subpackage.
"""
