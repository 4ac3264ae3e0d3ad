"""Training-data operators: scans, deduplication, filters, mixing.

Nothing else in the library imports this subpackage.
"""
