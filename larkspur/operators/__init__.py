"""Operators of the product-search engine."""
