"""Whole queries, and their SQL."""
