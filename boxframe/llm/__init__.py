"""Operators for training data, each with its registered query."""
