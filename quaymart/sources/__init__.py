"""Readers, writers and the role bindings of the star-schema tables."""
