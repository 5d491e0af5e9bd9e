"""Operators for training-data pipelines over texts and web pages.

Nothing else in the package imports this subpackage.
"""
