"""Sources of the product-search engine."""
