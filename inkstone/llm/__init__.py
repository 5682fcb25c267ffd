"""Operators for training data made of text and vectors. Nothing outside this package imports it."""
