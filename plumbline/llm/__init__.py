"""Operators for preparing large text corpora: search, dedup, tokens, quality, privacy, scoring.

Nothing outside this subpackage imports it. ``queries.py`` lists its registered queries.
"""
