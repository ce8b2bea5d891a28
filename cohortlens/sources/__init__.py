"""Readers, writers and layered tables."""
