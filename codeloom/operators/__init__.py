"""Operators over the ``functions`` table and what is derived from it."""
