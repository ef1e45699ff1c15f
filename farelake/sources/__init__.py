"""Readers, writers, seed rows and the mapping of the test tables."""
