"""Readers and writers for drop folders, normalized readings and sample files."""
