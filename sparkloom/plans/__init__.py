"""Whole queries over the relational tables."""
