"""Readers, writers and the views of the input tables."""
