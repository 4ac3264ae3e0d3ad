"""Derived inputs and the query registry used by the entry module and bench."""
