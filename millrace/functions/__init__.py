"""Columns from parsed predicates and arithmetic."""
