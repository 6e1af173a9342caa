"""Readers, writers, dataset loaders and their registry."""
