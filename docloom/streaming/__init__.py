"""Watching queries over a stream of changes."""
