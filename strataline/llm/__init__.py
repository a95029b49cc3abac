"""Operators for building training data from code-intelligence tables."""
