"""Readers and writers for the file formats in scope."""
