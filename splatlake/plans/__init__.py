"""Queries, presets and their plans."""
