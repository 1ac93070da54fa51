"""Functions of the product-search engine."""
