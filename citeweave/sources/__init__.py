"""Readers, writers and the shared scratch store."""
