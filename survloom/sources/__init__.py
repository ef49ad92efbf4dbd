"""Readers, writers and the survival frames built from input tables."""
