"""Operators over the code graph and its tables."""
