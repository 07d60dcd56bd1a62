"""Operators that prepare training data for language models.

Nothing outside this package imports it; it can be removed without touching the rest of the library.
"""
