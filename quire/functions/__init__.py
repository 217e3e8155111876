"""Scalar functions over columns; built-in expressions wherever they can express the rule."""
