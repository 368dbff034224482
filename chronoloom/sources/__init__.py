"""Readers, writers and stored tables."""
