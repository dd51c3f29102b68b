"""Readers, writers and the input tables."""
