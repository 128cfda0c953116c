"""Dimensions and queries."""
