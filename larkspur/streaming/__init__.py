"""Streaming of the product-search engine."""
