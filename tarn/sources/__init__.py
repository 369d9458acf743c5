"""Readers, writers, generated data and intermediate tables."""
