"""Readers and writers of vector and id files."""
