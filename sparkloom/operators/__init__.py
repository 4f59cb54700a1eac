"""Joins and orders that one built-in call doesn't give at scale."""
