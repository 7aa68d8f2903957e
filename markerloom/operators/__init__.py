"""Operators over marker tables."""
