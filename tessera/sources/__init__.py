"""Readers, writers and adapters that build the canonical relations."""
