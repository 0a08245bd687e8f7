"""Analyses composed from several operators."""
