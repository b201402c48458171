"""Versioned graphs: immutable tables, commits, branches, differences, merges."""
