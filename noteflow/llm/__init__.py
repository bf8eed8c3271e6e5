"""Operators for preparing text corpora, and the registered queries that apply them."""
