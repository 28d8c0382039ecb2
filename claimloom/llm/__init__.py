"""Operators for training data: matching, grouping, splitting, encoding, mixing and scoring.

Nothing outside this subpackage imports it.
"""
