"""Relational operators on trace tables."""
