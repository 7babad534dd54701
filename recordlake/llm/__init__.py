"""Operators for preparing text corpora.  Nothing outside this package imports it."""
