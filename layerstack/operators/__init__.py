"""Operators on feature tables, row blocks and weight tables."""
