"""Aggregates, lookups, time travel and writes."""
