"""Columns over paths and values."""
