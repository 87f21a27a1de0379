"""Operators over splat tables: DataFrame in, DataFrame out."""
