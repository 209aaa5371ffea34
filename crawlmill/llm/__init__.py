"""Operators for training data over the crawl index. Nothing else in the library imports this."""
