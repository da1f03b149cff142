"""Readers, writers and the small artefacts stored beside tables."""
