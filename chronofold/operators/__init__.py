"""Relational operators: each a function of DataFrames, with explicit ordinals."""
