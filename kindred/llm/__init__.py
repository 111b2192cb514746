"""Operators for preparing training corpora of language models.

Nothing outside this package imports it.
"""
