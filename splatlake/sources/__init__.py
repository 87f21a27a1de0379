"""Readers and writers of splat files."""
