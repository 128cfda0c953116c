"""Operators for large-scale training-data work on text and page tables.

Nothing outside this subpackage imports it, so it can be removed without touching the rest of the library.
"""
