"""Operators for building training corpora: search, scoring, filtering, extraction and tokenizing.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
