"""Operators of a training-data pipeline over tables of documents and pages.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
