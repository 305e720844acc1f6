"""Operators for training-data pipelines: packing, scans, classifiers, deduplication, search, tokens.

Nothing else in the library imports this subpackage.
"""
