"""Operators for building training corpora from raw text tables.

Nothing else in the library imports this subpackage; it can be deleted without touching the rest.
"""
