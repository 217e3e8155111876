"""Whole queries: the search request and the registered queries over the driver's tables."""
