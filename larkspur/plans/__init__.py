"""Plans of the product-search engine."""
