"""Queries over the provided tables, each with its oracle."""
