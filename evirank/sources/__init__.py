"""Readers, writers and file integrity."""
