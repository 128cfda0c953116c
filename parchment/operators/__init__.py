"""Operators over findings and documents."""
