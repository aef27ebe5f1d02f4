"""Operators for training data on text and on pairs; nothing else in the library imports this package."""
