"""Analyses and utilities built of the operators."""
