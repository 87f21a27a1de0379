"""Structured Streaming over splat records and camera poses."""
