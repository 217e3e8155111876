"""Training-data operators: mixing, chat formatting, near duplicates, quality, packing,
sharding, toxicity, URL rules, exact vector search and language identification.

Nothing outside this subpackage imports it.
"""
