"""Corpus operators for building training data."""
