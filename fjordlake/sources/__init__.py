"""Readers and generators of the package's tables."""
