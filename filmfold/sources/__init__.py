"""Readers, writers and the views that shape the given tables into ratings data."""
